"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from folia.llm.bpe import op10_bpe
from folia.llm.language import op3_language
from folia.llm.licenses import op2_licenses
from folia.llm.licenses import oracle as licences
from folia.llm.media import ORACLE as MEDIA
from folia.llm.media import op7_media
from folia.llm.neardup import ORACLE as NEAR_DUPLICATES
from folia.llm.neardup import op5_near_duplicates
from folia.llm.packing import op1_packing
from folia.llm.quality import ORACLE as QUALITY
from folia.llm.quality import op8_quality
from folia.llm.sharding import ORACLE as SHARDING
from folia.llm.sharding import op6_sharding
from folia.llm.substrings import ORACLE as SUBSTRINGS
from folia.llm.substrings import op4_substrings
from folia.llm.urls import op9_urls

QUERIES = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_substrings": op4_substrings,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_sharding": op6_sharding,
    "op7_media": op7_media,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op2_licenses": licences(),
    "op4_substrings": SUBSTRINGS,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op6_sharding": SHARDING,
    "op7_media": MEDIA,
    "op8_quality": QUALITY,
}
