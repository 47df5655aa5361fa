"""Components, url rules and aliases."""

import random

import pytest

from factloom.llm.components import connected_components
from factloom.llm.url_rules import Rule, judge


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {(x, root(x)) for x in parent}


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + k, 999) for k in range(150)] + [(2000 + k, 2001 + k) for k in range(64)]
    rows = [*edges, edges[0], (7, 7), (None, 1), (1, None)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == brute(edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "x.net/"), Rule("allow", "x.net/ok")]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1?x#y", "<p>"),
        (2, "http://q.net/a", '<link rel="canonical" href="https://b.x.net/p">'),
        (3, "http://r.net/a", "<meta http-equiv=refresh content='0; url=http://q.net/a'>"),
        (4, None, None),
        (5, "nourl", "x"),
        (6, "http://s.net#f", "<link href='/z' rel=canonical>"),
        (7, "http://t.net/", '<link rel="canonical" href="http://x.net/"><meta http-equiv="refresh" content="1;url=http://k.org/">'),
        (8, "http://x.net/ok/1", None),
        (9, "http://r.net/a#part", None),
        (9, "http://r.net/a#part", None),
        (None, "http://notexample.org/es/", ""),
        (10, "http://s.net/z", ""),
        (11, "ftp://", ""),
        (12, "http://u.net/", '<link data-rel="x" rel="canonical" data-href="https://b.x.net/p" href="http://v.net/"><meta http-equiv="refresh" content="0" data-url="https://b.x.net/p">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "1 AS component", "'v' AS verdict", "'n' AS node")
    return [tuple(r) for r in judge(pages, RULES).collect()]


def test_verdicts(judged):
    by = {r[0]: r[1:] for r in judged}
    assert by[1] == ("a.example.org", "/es/1", "example.org/es/", "block", False)
    assert by[2][2:] == (None, "block", True)  # its canonical url is blocked
    assert by[3][2:] == (None, "block", True)  # two links away
    assert by[4] == by[5] == by[11] == ("", "", None, "allow", False)
    assert by[6] == ("s.net", "", None, "allow", False)
    assert by[7][2:] == (None, "allow", False)  # an alias is allowed explicitly
    assert by[12][2:] == (None, "allow", False)  # data-href is no link
    assert by[8][2:] == ("x.net/ok", "allow", False)
    assert by[9][2:] == (None, "block", True) and len(judged) == 14
    assert by[None][2:] == ("org/", "allow", False)


def test_no_pages(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0
