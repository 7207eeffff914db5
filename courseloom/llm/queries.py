"""The registered queries of this subpackage, with their SQL."""

from courseloom.llm import (  # noqa: F401
    decontaminate, extract, lines, multiprobe, packing, quality, secrets, simhash, spelling, tokens, toxicity, warc, whitening)
from courseloom.llm.common import QUERIES, SQL  # noqa: F401
