"""Bibliographies, reviewers' shares and references against plain loops."""

import random
import re

import pytest

from tarnwork.operators import manuscripts as M


def entries(lines):
    lines = [x.strip() for x in lines if x and x.strip()]
    by_number = sum(bool(re.match(M.NUMBERED, x)) for x in lines) >= 5
    out, now = [], []
    for x in lines:
        opens = re.match(M.NUMBERED, x) if by_number else re.match(M.ENTRY_START, x) and re.search(M.YEAR, " ".join(now))
        if opens and now:
            out.append(" ".join(now))
            now = []
        now.append(x)
    out.append(" ".join(now))
    clean = [re.sub(r"(?<=[a-z])-\s+(?=[a-z])", "", re.sub(M.NUMBERED, "", re.sub(r"\s+", " ", e))) for e in out]
    return [e for e in clean if len(e) > 25 and re.search(M.YEAR, e)]


def test_bibliography_entries_equal_the_loop(spark):
    rng = random.Random(3)
    starts = ["T. Akiba and others write", "Akiba, Takuya says", "Jimmy L. Ba", "and then more of it", "  a line that ends exam-", "ple here", "", "published in 2015.", "Proc. of 1999", "[3] Something"]
    docs = {i: [rng.choice(starts) for _ in range(rng.randint(1, 25))] for i in range(30)}
    docs |= {100 + i: [f"[{k}] {rng.choice(starts)} {rng.choice(['2015', ''])}" if rng.random() < 0.5 else rng.choice(starts) for k in range(20)] for i in range(10)}
    rows = [(d, n, t) for d, lines in docs.items() for n, t in enumerate(lines)] + [(200, 0, None)]
    got = {}
    for r in M.bibliography_entries(spark.createDataFrame(rows, "doc_id long, line long, text string")).orderBy("doc_id", "entry").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {d: e for d, lines in docs.items() if any(x.strip() for x in lines) and (e := entries(lines))}


@pytest.mark.parametrize("entry,title", [
    ("T. Akiba, S. Sano. Optuna: a framework for search. In KDD, 2019.", "Optuna: a framework for search"),
    ('Smith, J. "A title in quotation marks, long," Journal, 2020.', "A title in quotation marks, long"),
    ("nothing like an author list here 2001", "nothing like an author list here 2001"), (None, None), ("", ""),
])
def test_titles(entry, title):
    assert M.guessed_title(entry) == title


def share(lengths, budget, least):
    if sum(lengths) <= budget or not lengths:
        return lengths
    floor = min(least, budget // len(lengths))
    base = [min(x, floor) for x in lengths]
    left, over = budget - sum(base), sum(lengths) - sum(base)
    return base if left <= 0 or over <= 0 else [b + left * (x - b) // over for b, x in zip(base, lengths)]


def test_allowances_equal_the_loop(spark):
    rng = random.Random(8)
    rows = [(d, s, rng.choice(["a", "b", None]), rng.choice([0, 5, 40, 300, 900, None])) for d in range(40) for s in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "doc_id long, span long, lane string, length long")
    allowed = M.allowances(df, ["a", "b", "c"], 500, 30, 6)
    got = {(r["doc_id"], r["reviewer"], r["span"]): r["allowance"] for r in allowed.collect()}
    want, seen = {}, {}
    for d in range(40):
        for who in "abc":
            own = [(s, n or 0) for e, s, lane, n in rows if e == d and lane == who]
            loose = [(s, n or 0) for e, s, lane, n in rows if e == d and lane is None]
            total = sum(n for _, n in own)
            reserve = min(sum(n for _, n in loose), 500 // 6) if total >= 500 else 500 - total
            for part, budget in ((own, 500 - reserve if total >= 500 else total), (loose, reserve)):
                for (s, _), a in zip(part, share([n for _, n in part], budget, 30)):
                    want[d, who, s] = a
                    seen[d, s] = max(seen.get((d, s), 0), a)
    assert got == want
    for r in M.scoping_coverage(df, allowed).collect():
        mine = [(s, n or 0) for e, s, _, n in rows if e == r["doc_id"]]
        assert r["covered"] == sum(seen.get((r["doc_id"], s), 0) for s, _ in mine) and r["chars"] == sum(n for _, n in mine)


def test_references(spark):
    refs = spark.createDataFrame([(1, 1, "Ann Lee", 2020, "x"), (1, 2, "Bo Kim", 2021, "Learning deeper networks quickly"), (1, 3, None, None, None), (2, 4, "Ann Lee", 2020, "x"), (3, 5, "C. Li", 1999, "y")], "draft_id long, ref_id long, author string, year int, title string")
    drafts = spark.createDataFrame([(1, "As LEE et al. (2020) show, deeper networks are learning quickly."), (2, None), (3, "li 1999")], "draft_id long, text string")
    assert {r["ref_id"] for r in M.unused_references(refs, drafts).collect()} == {3, 4, 5}
    claims = spark.createDataFrame([(1, 1, "deeper networks learning"), (1, 2, "of a"), (2, 1, "deeper networks"), (1, 3, None)], "draft_id long, claim_id long, text string")
    named = refs.select("draft_id", "ref_id", refs.title.alias("text"))
    assert {(r["claim_id"], r["ref_id"], r["overlap"]) for r in M.references_for_claims(claims, named).collect()} == {(1, 2, 1.0)}
