from tallyvine.sources.delimited import bad_cells, in_file_order, read_batch, read_delimited, read_harvest, read_predictions
from tallyvine.sources.scratch import scratch_path, store
from tallyvine.sources.star import harvest_facts
from tallyvine.sources.tables import read_table

__all__ = [
    "bad_cells",
    "harvest_facts",
    "in_file_order",
    "read_batch",
    "read_delimited",
    "read_harvest",
    "read_predictions",
    "read_table",
    "scratch_path",
    "store",
]
