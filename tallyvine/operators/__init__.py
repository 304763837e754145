from tallyvine.operators.aggregates import (
    category_frequency,
    category_shares,
    distinct_farms,
    grand_total,
    production_by,
    row_count,
    total_by_campaign,
)
from tallyvine.operators.encoding import ordered_codes
from tallyvine.operators.filling import fill_by_key, fill_by_position, fill_open_by_key
from tallyvine.operators.ordering import distinct_campaigns, page_end, page_rows, sort_rows
from tallyvine.operators.positions import split_at, with_position
from tallyvine.operators.selection import (
    catalogue,
    closed_campaigns,
    column_at,
    filter_rows,
    for_campaign,
)

__all__ = [
    "catalogue",
    "category_frequency",
    "category_shares",
    "closed_campaigns",
    "column_at",
    "distinct_campaigns",
    "distinct_farms",
    "fill_by_key",
    "fill_by_position",
    "fill_open_by_key",
    "filter_rows",
    "for_campaign",
    "grand_total",
    "ordered_codes",
    "page_end",
    "page_rows",
    "production_by",
    "row_count",
    "sort_rows",
    "split_at",
    "total_by_campaign",
    "with_position",
]
