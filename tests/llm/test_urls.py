import math
import random
import re
from collections import Counter

import pytest

from tidewell.llm import urls

URLS = [
    ("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "com/en/", "block"),
    ("https://example.com/en/7a?x=/en/", "example.com", "/en/7a", "example.com/en/7", "allow"),
    ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("https://m.example.net/de/8#t", "m.example.net", "/de/8", "example.net/de/8", "block"),
    ("x://net/de/", "net", "/de/", "net/de/", "allow"),
    ("http://a.org/es/", "a.org", "/es/", "org/es/", "block"),
    ("http://a.org?es/", "a.org", "", None, None),
    ("http://a.org#x/y", "a.org", "", None, None),
    ("http://É.Org/Ab://c", "É.org", "/Ab://c", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "<p>the shon ti the</p>", "x") for i, u in enumerate(rows)], "page_id long, url string, html string, host string")


def run(spark, rows):
    p = frame(spark, rows)
    words = urls.lexicon(p)
    return {r.page_id: r for r in urls.judge(p, words, urls.train(p, words)).collect()}


def test_rules(spark):
    got = run(spark, [u for u, *_ in URLS])
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def test_bayes_learns_from_decided_urls(spark):
    rows = [f"http://shop{w}.example.com/en/{i}" for i, w in enumerate(["the", "ti"] * 20)] + [f"http://good.example.net/de/1{i}" for i in range(40)] + ["http://shopthe.example.com/fr/1", "http://good.example.net/fr/2"]
    got = run(spark, rows)
    assert got[80].verdict == "block" and got[81].verdict == "allow"
    assert run(spark, []) == {}


def test_viterbi():
    words = {w: math.log(p) for w, p in {"the": 0.4, "shon": 0.3, "ti": 0.2, "theshon": 0.01}.items()}
    s = urls.Segmenter(words)
    assert s.split("theshonti") == ("the", "shon", "ti")
    assert s.split("") == ()

    def best(name):
        if not name:
            return 0.0, ()
        out = []
        for k in range(1, min(len(name), urls.LONGEST) + 1):
            p = words.get(name[:k], s.unknown - k * math.log(10.0))
            q, rest = best(name[k:])
            out.append((p + q, (name[:k], *rest)))
        return max(out)

    for name in ("thetishon", "xthey", "tititheq", "shonshon"):
        found = s.split(name)
        assert "".join(found) == name
        assert sum(words.get(w, s.unknown - len(w) * math.log(10.0)) for w in found) == pytest.approx(best(name)[0])


def test_rare_words_count(spark):
    """Over 50,000 words that are seen once, among them those that a host needs."""
    text = " ".join("x" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000)) + " glimmer quorn"
    rows = [(i, f"http://glimmer{'quorn' if i % 2 else 'zzzz'}.example.com/en/{i}", text if not i else "", "") for i in range(4)]
    p = spark.createDataFrame([*rows, (9, "http://glimmer.example.org/fr/1", None, "")], "page_id long, url string, html string, host string")
    words = urls.lexicon(p)
    assert words.total == 60_002 and words.least == 1
    split = sorted(tuple(r) for r in urls.segments(p.select(urls.parts()[0].alias("host")), words).where("t like 'n:glimmer%'").collect())
    assert [r for r in split if r[0] == "n:glimmerquorn"] == [("n:glimmerquorn", 0, "glimmer"), ("n:glimmerquorn", 1, "quorn")]
    model = urls.train(p, words)
    assert {r.t: (r.a, r.b) for r in model.tokens.where("t in ('h:glimmer', 'h:quorn')").collect()} == {"h:glimmer": (0, 4), "h:quorn": (0, 2)}
    assert {r.page_id: r.verdict for r in urls.judge(p, words, model).collect()}[9] == "block"


def plain_verdicts(rows):
    """Word counts, Viterbi, token counts and Bayes over all pages, in dictionaries. rows: (url, html)."""
    count = Counter()
    for _, html in rows:
        count.update(urls._WORD.findall(re.sub(r"<[^>]*>", " ", html or "").lower()))
    total, least = sum(count.values()) or 1, min(count.values(), default=1)
    cut = urls.Segmenter({w: math.log(n / total) for w, n in count.items()}, math.log(least / total))

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path

    def rule(host, path):
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: len(r[1] + r[2]))[0] if fits else None

    def tokens(host, path):
        out = []
        for t in urls.pieces(host, path):
            out += ["h:" + w for w in cut.split(t[2:])] if t[0] == "n" else [t]
        return out

    seen, n_urls = {"allow": Counter(), "block": Counter()}, Counter()
    for url, _ in rows:
        host, path = split(url)
        if (v := rule(host, path)) is not None:
            seen[v].update(tokens(host, path))
            n_urls[v] += 1
    known = set(seen["allow"]) | set(seen["block"])
    n, na, nb = len(known) + 1, sum(seen["allow"].values()), sum(seen["block"].values())
    out = []
    for url, _ in rows:
        host, path = split(url)
        v = rule(host, path)
        if v is None:
            odds = math.log((n_urls["block"] + 1) / (n_urls["allow"] + 1)) if n_urls else -1.0
            for t in tokens(host, path):
                if t in known:
                    odds += math.log((seen["block"][t] + 1) / (nb + n)) - math.log((seen["allow"][t] + 1) / (na + n))
            v = "block" if odds > 0 else "allow"
        out.append((host, path, v))
    return out


def test_verdicts_as_plain_loops(spark):
    """Also null and repeated rows, null and empty pages, very long urls and hosts, and clashing columns."""
    rng = random.Random(7)
    words = ["shop", "good", "news", "cheap", "play", "read", "more", "win"]
    html = lambda: "<p>" + " ".join(rng.choice(words) for _ in range(30)) + "</p>"
    host = lambda: "".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    rows = [(f"http://{host()}.example.{rng.choice(['com', 'net', 'org', 'dev'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(words)}{rng.randint(1, 9)}", html()) for _ in range(150)]
    rows += [(None, None), ("", ""), ("http://x", None), ("http://" + "good" * 60 + ".dev/" + "win/" * 3000, html()), ("http://É中.dev/Ä", "<b>"), rows[0], rows[0], (rows[1][0], None)]
    p = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, verdict string, t string")
    words_ = urls.lexicon(p)
    got = {r.page_id: (r.host, r.path, r.verdict) for r in urls.judge(p, words_, urls.train(p, words_)).collect()}
    want = plain_verdicts(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert {v for _, _, v in want} == {"allow", "block"}
