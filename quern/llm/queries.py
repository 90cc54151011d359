"""All queries of this subpackage, by the names the driver calls them."""

from quern.llm import (
    chat,
    fill_middle,
    hard_negatives,
    licenses,
    line_rules,
    mixing,
    packing,
    pii,
    repeats,
    simhash,
    sketches,
    toxicity,
    wrappers,
)

_MODULES = (
    simhash,
    toxicity,
    packing,
    line_rules,
    mixing,
    chat,
    wrappers,
    sketches,
    licenses,
    repeats,
    fill_middle,
    pii,
    hard_negatives,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
