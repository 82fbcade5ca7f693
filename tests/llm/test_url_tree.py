"""The path-template tree against a recursion in Python, and cases in which only the tree can decide."""

import os
import random

import pytest

from weir.llm import urls


def tree(shapes, purity, template="", out=None):
    """shapes: {whole shape: (rest, seen, bad)} of one node; ``out``: {shape: (template, purity)}."""
    out = {} if out is None else out
    rests = [r for r, _, _ in shapes.values()]
    seen, bad = sum(s for _, s, _ in shapes.values()), sum(b for _, _, b in shapes.values())
    shared = os.path.commonprefix(rests)
    template += "".join(f"/{s}" for s in shared)
    if bad in (0, seen) or len(set(rests)) == 1:
        template += "" if len(set(rests)) == 1 else "/~"
        out.update({shape: (template, purity) for shape in shapes})
        return out
    branches = {}
    for shape, (rest, s, b) in shapes.items():
        rest = rest[len(shared) :]
        branches.setdefault(rest[0] if rest else "", {})[shape] = (rest[1:], s, b)
    p = (bad + 0.5) / (seen + 1)
    names = {}
    for segment, of in branches.items():
        n, k = sum(s for _, s, _ in of.values()), sum(b for _, _, b in of.values())
        names[segment] = (k - n * p) ** 2 <= 1.96**2 * n * p * (1 - p)
    merged = sum(names.values()) > 1
    children = {}
    for segment, of in branches.items():
        children.setdefault("~" if names[segment] and merged else segment, {}).update(of)
    for name, of in children.items():
        n, k = sum(s for _, s, _ in of.values()), sum(b for _, _, b in of.values())
        tree(of, purity if len(children) == 1 else (k + 2 * purity) / (n + 2), f"{template}/{name}", out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_a_recursion(spark, seed):
    rng = random.Random(seed)
    rows = [(h, "/".join(rng.choice("abcde") for _ in range(rng.randint(0, 5)))) for h in ("one.org", "two.org", "three.org") for _ in range(400)]
    rules = {f"{h}/{a}/{b}": rng.choice(["block", "allow"]) for h in ("one.org", "two.org") for a in "abc" for b in "abcde" if rng.random() < 0.6}
    df = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate(rows)], "page_id long, url string")
    got = urls.judge(df, rules).collect()
    hosts = {}
    for h, p in rows:
        rule = max((r for r in rules if f"{h}/{p}".startswith(r)), key=len, default=None)
        s, b = hosts.setdefault(h, {}).get(tuple(x for x in p.split("/") if x), (0, 0))
        hosts[h][tuple(x for x in p.split("/") if x)] = (s + (rule is not None), b + (rule is not None and rules[rule] == "block"))
    want = {}
    for h, shapes in hosts.items():
        seen, bad = sum(s for s, _ in shapes.values()), sum(b for _, b in shapes.values())
        want[h] = tree({k: (k, s, b) for k, (s, b) in shapes.items()}, (bad + 1) / (seen + 2))
    assert len(got) == len(rows)
    for r in got:
        template, purity = want[r["host"]][tuple(x for x in r["path"].split("/") if x)]
        assert r["template"] == template and r["purity"] == pytest.approx(purity) and (r["rule"] or r["verdict"] == ("block" if purity >= 0.8 else "allow"))
    assert {r["verdict"] for r in got if not r["rule"]} == {"block", "allow"}


def judged(spark, rows, rules):
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    return {r["page_id"]: r for r in urls.judge(df, rules).collect()}


def test_an_unlabelled_branch_is_judged_by_its_host(spark):
    rows = [f"http://bad.org/es/{i}" for i in range(20)] + ["http://bad.org/xx/7", "http://bad.org/yy/zz/7"] + [f"http://good.org/ok/{i}" for i in range(20)] + ["http://good.org/xx/7", "http://none.org/xx/7"]
    got = judged(spark, rows, {"bad.org/es/": "block", "good.org/ok/": "allow"})
    assert [got[i]["verdict"] for i in (20, 21, 42, 43)] == ["block", "block", "allow", "allow"]
    assert got[20]["rule"] is None and got[20]["template"] == "/~" and got[20]["purity"] == pytest.approx(21 / 22)


def test_wildcards_before_a_segment_that_tells(spark):
    users = ["ann", "ben", "eve", "joe", "kim", "lea"]
    rules = {f"h.org/{u}/spam": "block" for u in users[:5]} | {f"h.org/{u}/blog": "allow" for u in users[:5]}
    got = judged(spark, [f"http://h.org/{u}/{k}" for u in users for k in ("spam", "blog") for _ in range(8)], rules)
    lea = {r["path"]: (r["template"], r["verdict"], r["rule"]) for r in got.values() if "lea" in r["path"]}
    assert lea == {"/lea/spam": ("/~/spam", "block", None), "/lea/blog": ("/~/blog", "allow", None)}


def test_deep_branches_are_told_apart(spark):
    deep = "/".join("abcdefgh")
    rows = [f"http://h.org/{deep}/{k}/{n}" for k in ("x", "y") for n in ("p", "q", "r") for _ in range(9)]
    got = judged(spark, rows, {f"h.org/{deep}/x/{n}": "block" for n in "pq"} | {f"h.org/{deep}/y/{n}": "allow" for n in "pq"})
    last = {r["path"][-3:]: (r["rule"], r["verdict"]) for r in got.values()}
    assert last["x/r"] == (None, "block") and last["y/r"] == (None, "allow")
