import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hourloom.llm import url_filter as uf


def fits(pattern, subject):
    out = "".join(".*" if x is uf._RUN else "." if x is uf._ANY else re.escape(chr(x)) for x in pattern)
    return re.fullmatch(out, subject.decode("latin-1"), re.DOTALL) is not None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab*?", max_size=7), min_size=1, max_size=30), st.lists(st.text(alphabet="ab", max_size=12), max_size=12))
def test_automaton_agrees_with_regular_expressions(globs, subjects):
    patterns = [uf._globbed(g) for g in globs]
    got = uf.WildcardAutomaton(patterns).matches([s.encode() for s in subjects])
    assert got.tolist() == [[fits(p, s.encode()) for p in patterns] for s in subjects]


def judge(url):
    return uf.UrlJudge().judge([url])[0]


def test_rules():
    assert judge("http://A.Example.NET/en/x?y") == ("a.example.net", "/en/x", "example.net/en/", "allow", None)
    assert judge("http://a.example.net/de/") == ("a.example.net", "/de/", "net/", "block", None)
    assert judge("http://m.example.net/en/") == ("m.example.net", "/en/", "example.net/en/", "allow", "m.* *")
    assert judge("http://example.net") == ("example.net", "", None, "allow", None)
    assert judge("http://badexample.com/de/") == ("badexample.com", "/de/", None, "allow", None)
    assert judge("http://x.com/a.net/en/")[2:4] == (None, "allow")
    assert judge("http://x.com/a/login.php")[3:] == ("block", "* */login*")
    assert judge("ftp://ORG/fr/#top") == ("org", "/fr/", "org/fr/", "allow", None)
    assert judge("http://Ä.org/fr/é\0/")[:3] == ("Ä.org", "/fr/é\0/", "org/fr/")


def test_odd_rows(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "http://", "http://?", "http://h#a/b", "a://b://c/d", "http://x.net/" + "p" * 30_000]
    urls += ["http://" + "".join(rng.choice("am.net/") for _ in range(12)) for _ in range(50)]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, urls[6], "r")] * 2, "page_id bigint, url string, rule string")
    got = sorted((tuple(r) for r in uf.judge_pages(pages).collect()), key=str)
    want = [(i, *judge(u)) for i, u in enumerate(urls)] + [(None, *judge(urls[6]))] * 2
    assert got == sorted(want, key=str)
    assert uf.judge_pages(pages.limit(0)).collect() == []
