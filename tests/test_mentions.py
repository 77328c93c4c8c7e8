from __future__ import annotations

import random
import re

from factorloom.operators import mentions as M


def brute(texts: list[tuple], names: list[tuple]) -> list[tuple]:
    out = []
    for key, text in texts:
        low = (text or "").lower()
        for entity in {e for e, n, _ in names if n}:
            for e, name, bound in names:
                if e != entity or not name:
                    continue
                n = re.escape(name.lower())
                left, right = (r"(?<![a-z0-9_])" if re.match(r"[a-z0-9_]", name.lower()) else ""), (r"(?![a-z0-9_])" if re.match(r"[a-z0-9_]", name.lower()[-1]) else "")
                if re.search(left + n + right if bound == M.WORD else n, low):
                    out.append((key, entity))
                    break
    return sorted(out)


def found(spark, texts, names, **more):
    df = M.entity_mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "entity string, name string, bound string"), **more)
    return sorted(tuple(r) for r in df.collect())


NAMES = [
    ("BRK-B", "BRK-B", M.WORD), ("BRK-B", "berkshire", M.ANYWHERE), ("A", "A", M.WORD), ("IT", "it", M.WORD), ("NATION_1", "NATION_1", M.WORD), ("NATION_12", "NATION_12", M.WORD),
    ("GM", "General Motors", M.WORD), ("GE", "General", M.ANYWHERE), ("X", "+x+", M.WORD), ("E", "émile", M.WORD), ("none", None, M.WORD), ("empty", "", M.ANYWHERE), ("GE", "GE", M.WORD),
]
TEXTS = [
    (1, "$A and A$ but not AB"), (2, "brk-b, BRK-BX"), (3, "nation_1 NATION_12"), (4, "xnation_1 nation_1x nation_123"), (5, "general motors; generally"), (6, None), (7, ""), (8, "a+x+b"),
    (9, "Émile and Émiles"), (10, "General\nMotors"), (11, "it"), (12, "bit it_ 1it it1"), (13, "oberkshire"), (14, "ge " * 5000), (1, "GM is General Motors"),
]


def test_words_parts_and_names_of_several_words(spark):
    got = found(spark, TEXTS, NAMES)
    assert got == brute(TEXTS, NAMES)
    assert (3, "NATION_1") in got and (4, "NATION_1") not in got and (1, "A") in got and (5, "GM") in got and (9, "E") in got


def test_many_automata_find_the_same(spark):
    r = random.Random(4)
    texts = [(i, "".join(r.choice("ab_ $1") for _ in range(60))) for i in range(60)]
    names = [(f"e{i % 25}", "".join(r.choice("ab_ $1") for _ in range(r.randint(1, 4))), r.choice([M.WORD, M.ANYWHERE])) for i in range(60)]
    want = brute(texts, names)
    assert found(spark, texts, names) == want
    assert found(spark, texts, names, most=150) == want


def test_nothing_to_find(spark):
    assert found(spark, TEXTS, [("e", None, M.WORD)]) == []
    assert found(spark, [(1, None)], NAMES) == []


def test_names_of_companies(spark):
    companies = spark.createDataFrame([("AAPL", "Apple, Inc."), ("F", "Ford Motor"), ("T", "ATT Co"), ("Z", None)], "ticker string, company string")
    got = {tuple(r) for r in M.company_names(companies).where("name is not null").collect()}
    assert got == {("AAPL", "AAPL", M.WORD), ("F", "F", M.WORD), ("T", "T", M.WORD), ("Z", "Z", M.WORD), ("AAPL", "apple", M.ANYWHERE), ("F", "ford", M.ANYWHERE)}
