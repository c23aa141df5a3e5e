"""All queries of the operators, collected from their modules."""

from vigilday.llm import (  # noqa: F401
    ann,
    chat,
    langid,
    licenses,
    mixing,
    neardup,
    packing,
    periods,
    quality,
    sharding,
    simhash,
    tokencount,
    trie,
)
from vigilday.llm.registry import QUERIES, SQL  # noqa: F401
