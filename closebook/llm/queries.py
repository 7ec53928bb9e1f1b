"""All registered queries of this subpackage."""

from closebook.llm import (  # noqa: F401
    decontaminate,
    filteraudit,
    fingerprints,
    linededup,
    minhash,
    packing,
    pages,
    quality,
    search,
    secrets,
    suffixdedup,
    toxicity,
    warc,
)
from closebook.llm.common import ORACLES, QUERIES  # noqa: F401
