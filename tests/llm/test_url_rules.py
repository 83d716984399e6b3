from __future__ import annotations

import random
import re

import pytest

from millrace.llm import url_rules
from millrace.llm.url_rules import RULES, SITES, Automaton, glob, regex_of, site

PAGES = "page_id long, url string, html string, rule string, host string, `__text` string"


def parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    tail = rest[len(host) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return host, re.split("[?#]", tail)[0], f".{host}{tail.split('#')[0]}"


def brute(url):
    """host, path, rule, verdict by the words of the contract; globs by regular expressions."""
    host, path, whole = parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = whole is not None and any(re.search(regex_of(r.glob), whole, re.DOTALL) for r in RULES if r.name is None)
    return host, path, None, "block" if hit else "allow"


def urls():
    pick = random.Random(11)
    hosts = ["net", "NET", "xnet", "a.net", "example.net", "W.Example.net", "notexample.net", "example.com", "b.example.com", "org", "x.org", "m.ads-track.example.com", "", "é.org", "a*b.net"]
    tails = ["", "/", "/en", "/en/", "/en/1", "/de/", "/DE/", "/fr/a.jpg", "?x/en/", "#/en/", "/en?a#b", "/x?sessionid=1", "/wp-admin/x", "/é/fr/", "/\n/x.css", "?.net/", "/a.net/b", "/.zip#x"]
    made = [f"{s}{h}{t}" for s in ("http://", "HTTPS://", "://", "a://b://", "mailto:") for h in hosts for t in tails]
    made += ["".join(pick.choice("a.:/?#net[]*é") for _ in range(pick.randint(0, 40))) for _ in range(300)]
    made += [None, "", "://", "http://" + "a." * 5000 + "net/" + "x" * 9000, "http://example.com/de/" + "y" * 200_000, "http://x.org/" + "/z" * 4000 + ".jpg"]
    return made + ["http://a.net/x"] * 50


def test_like_the_words_of_the_rules(spark):
    given = urls()
    df = spark.createDataFrame([(i, u, "h", "r", "x", "t") for i, u in enumerate(given)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(given)}


@pytest.mark.parametrize("rules", [1, 3, 40])
def test_masks_of_any_width(rules):
    pick = random.Random(rules)
    globs = ["".join(pick.choice(["a", "b", "*", "**", "[ab]", "/", "?", "[b-d]", "é"]) for _ in range(pick.randint(1, 25))) for _ in range(rules)]
    auto = Automaton([glob(g, "block") for g in globs])
    texts = ["".join(pick.choice("abcd/?é") for _ in range(pick.randint(0, 30))) for _ in range(400)] + ["a" * 5000, ""]
    found = auto.many([t.encode() for t in texts])
    for text, at in zip(texts, found, strict=True):
        fits = [i for i, r in enumerate(auto.rules) if re.search(regex_of(r.glob).replace("$", r"\Z"), text, re.DOTALL)]
        assert at == (fits[0] if fits else -1), text


def test_longest_site_rule_wins():
    auto = Automaton([site("com", "/a*", "allow"), site("x.com", "/", "block"), glob("**/a*", "allow"), site("com", "/a", "block")])
    best = auto.many([b".y.x.com/a*b", b".com/a*b", b".com/ab", b".org/a", b".org/b"])
    assert [auto.rules[i].name if i >= 0 else None for i in best] == ["x.com/", "com/a*", "com/a", None, None]
    assert [i >= 0 for i in best] == [True] * 4 + [False]


def test_too_many_rules_are_refused():
    with pytest.raises(ValueError, match="split the rules"):
        Automaton([glob("x" * 999, "block")] * 9000)
    with pytest.raises(ValueError, match="ASCII"):
        Automaton([glob("[é]", "block")])


def test_empty_table(spark):
    assert url_rules.judge(spark.createDataFrame([], PAGES), RULES).count() == 0
