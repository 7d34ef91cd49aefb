"""tessera: parallel-text preparation and translation evaluation as Spark jobs.

Sub-packages:

* ``sources``   -- readers, writers and the derived fixture tables
* ``functions`` -- Column expressions (text, arrays, masks, vectors)
* ``operators`` -- DataFrame operators (checks, tokenizers, ordering, metrics, ...)
* ``plans``     -- end-to-end plans (preparation report, evaluation) and the query catalog
* ``streaming`` -- Structured Streaming variants of the row-local steps
"""

from tessera.config import PrepConfig, SPECIAL_PIECES, UNK_ID, PAD_ID, SOS_ID, EOS_ID  # noqa: F401
from tessera.session import get_spark, checkpoint_root  # noqa: F401

__all__ = [
    "PrepConfig",
    "SPECIAL_PIECES",
    "UNK_ID",
    "PAD_ID",
    "SOS_ID",
    "EOS_ID",
    "get_spark",
    "checkpoint_root",
]
