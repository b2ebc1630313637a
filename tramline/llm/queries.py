"""The queries of this subpackage, and SQL for those that SQL can express."""

from .fingerprints import op4_fingerprints
from .licenses import op1_licenses, op1_sql
from .lines import op3_lines
from .nearcopies import op8_nearcopies
from .packing import op10_packing
from .pages import op6_pages
from .pieces import op9_pieces
from .sharding import op5_sharding
from .toxicity import op2_toxicity
from .vectors import op7_sql, op7_vectors

QUERIES = {f.__name__: f for f in (op1_licenses, op2_toxicity, op3_lines, op4_fingerprints, op5_sharding, op6_pages, op7_vectors, op8_nearcopies, op9_pieces, op10_packing)}
ORACLES: dict[str, str] = {"op1_licenses": op1_sql(), "op7_vectors": op7_sql()}
