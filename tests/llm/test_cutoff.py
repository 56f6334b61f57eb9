"""Endings and length hazards."""

import pytest

from docsift.llm import cutoff as C


@pytest.mark.parametrize(
    "text, kind",
    [
        ("All is said.", "whole"), ("Done!\n", "whole"), ("Er sagte „ja.“", "whole"), ("すべて終わり。", "whole"), ("", "whole"), (None, "whole"), ("  ", "whole"),
        ("It stops in the mid", "cut"), ("It stops in the ...", "cut"), ("The ratio of the [...]", "cut"), ("Three failed because t\n<!-- aborted", "cut"), ("lost in the transist&am", "cut"), ("当温度超过", "cut"),
        ("It is over.\n\n* * * * *", "whole"), ("It is over.\n\n– END –", "whole"), ("It is over.\n\n[End of document]", "whole"), ("It is over.\n\nTable 1: 3.1 / 4.8 / 5.0\n", "whole"),
        ("It is over.\n\n(3) E = k·d²", "whole"), ("It is over.\n\nExamined by: Unit 34", "whole"), ("It is over.\n\nFig. 1 to Fig. 7 follow", "whole"),
        ("It has a hollow flange.\nSigns:\n10 hollow flange\n12 flange", "doubtful"), ("It has a hollow flange.\nSigns:\n10 hollow flange\n12 hollow fla", "cut"), ("Claims\n1. One.\n2.", "doubtful"), ("It is kept below 0.", "doubtful"),
        ("It stops in the mid" + " " * 900, "cut"), ("It stops in the mid" + "\n" * 900, "cut"), ("It stops in the mid" + "\0" * 850, "cut"), ("All is said." + "\0" * 850, "whole"),
    ],
)
def test_judge(text, kind):
    got = C.judge(text)[0]
    assert got == kind


def test_found(spark):
    rows = [(i, "w" * (i % 90 + 5) + ".", "a") for i in range(600)]
    rows += [(1000 + i, ("Some words in a row. " * 9)[:100], "a") for i in range(40)]
    rows += [(2000, "Fine ending but doubtful at the limit.\nSigns:\n10 part\n12 " + "x" * 43, "a"), (2001, "Fine ending and doubtful away from it.\nSigns:\n10 part\n12 " + "x" * 33, "a")]
    assert len(rows[-2][1]) == 100
    rows += [(4000 + i, f"A text of another source, number {i}." + " And on." * (i % 7), "b") for i in range(3000)] + [(8000, "one that seems to stop", "b")]
    rows += [(3000, None, None), (3001, "no end here", None), (None, "no end", "a"), (1000, ("Some words in a row. " * 9)[:100], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ends = C.endings(df)
    limits = {(r.source, r.unit, r.size) for r in C.hazards(ends).filter("significant").collect()}
    assert ("a", "chars", 100) in limits and all(s[2] in (99, 100) for s in limits if s[0] == 'a')
    found = {r.doc_id for r in C.found(df).collect()}
    assert found == {1000 + i for i in range(40)} | {2000, 3001}
    why = {r.doc_id: (r.kind, r.at_limit, r.broken) for r in C.judged(df).filter("kind <> 'whole'").collect()}
    assert why[2000] == ("doubtful", True, False) and why[2001] == ("doubtful", False, False) and why[1000] == ("cut", True, False)
    assert why[3001] == ("cut", False, True) and why[8000] == ("cut", False, False)  # one in 3,001 texts may be misjudged
    rates = {r.source: (r.documents, r.truncated) for r in C.rates(df).collect()}
    assert rates[None] == (2, 1)
    assert C.found(df.limit(0)).count() == 0 and C.rates(df.limit(0)).count() == 0
