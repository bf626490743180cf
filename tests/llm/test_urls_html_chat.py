import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from llm_cases import prose
from sensorcal.llm import html as H
from sensorcal.llm.chat import CONTROL, assemble, escape, read_back, unescape
from sensorcal.llm.urls import RESIDUAL, url_verdicts


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_and_hosts(spark):
    urls = ["http://COM/x", "https://a.example.com/en/1?q", "http://www.example.com/en/", "http://x.www.example.com/en/2#f", "http://m.net/es/", "http://m.net/es", "http://netx/es/", "http://com", None, "example.com/en/", "http://", "x://Ä.COM/p?://net/es/"]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_verdicts(pages(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    assert got == {
        0: ("com", "/x", "com/"), 1: ("a.example.com", "/en/1", "example.com/en/"), 2: ("www.example.com", "/en/", "www.example.com/en/"),
        3: ("x.www.example.com", "/en/2", "www.example.com/en/"), 4: ("m.net", "/es/", "net/es/"), 5: ("m.net", "/es", None), 6: ("netx", "/es/", None),
        7: ("com", "", None), 8: ("", "", None), 9: ("", "", None), 10: ("", "", None), 11: ("Ä.com", "/p", "com/"),
    }


def test_trust_and_distrust_spread(spark):
    rows = [
        (1, "http://good.com/", '<a href="http://friend.org/x">'),
        (2, "http://friend.org/", "<a href=//second.org>"),
        (3, "http://second.org/", ""),
        (4, "http://spam.example.com/en/", ""),
        (5, "http://farm.org/", "<a href='http://spam.example.com/en/1'>"),
        (6, "http://alone.org/", None),
        (7, None, "<a href='http://spam.example.com/en/1'>"),
    ]
    got = {r.page_id: r for r in url_verdicts(pages(spark, rows + rows[-1:])).collect()}
    assert [got[k].verdict for k in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "allow", "allow"]
    assert got[3].trust > 0 and got[5].distrust > 0 and got[6].trust == got[6].distrust == 0
    assert url_verdicts(pages(spark, [])).count() == 0


def test_scores_against_brute_force(spark):
    """Trust and distrust over links, held against the same sums by hand until the stated residual."""
    rng = random.Random(9)
    hosts = [f"h{i}.{'com' if i < 4 else 'net' if i < 8 else 'org'}" for i in range(30)]
    rows, links = [], Counter()
    for i, h in enumerate(hosts):
        to = rng.choices(hosts, k=rng.randrange(4))
        links.update((h, t) for t in to if t != h)
        rows.append((i, f"http://{h}/{'fr' if 4 <= i < 8 else 'x'}/", " ".join(f'<a href="https://{t}/p">' for t in to)))
    got = {r.page_id: r for r in url_verdicts(pages(spark, rows)).collect()}
    for kind, seeds, edges in (("trust", hosts[:4], links), ("distrust", hosts[4:8], Counter({(b, a): n for (a, b), n in links.items()}))):
        start = {h: 1 / len(seeds) if h in seeds else 0.0 for h in hosts}
        out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
        rank = dict(start)
        for _ in range(200):
            moved = {h: 0.15 * start[h] + (0.85 * rank[h] if not out[h] else 0) for h in hosts}
            for (a, b), n in edges.items():
                moved[b] += 0.85 * rank[a] * n / out[a]
            rank = moved
        assert sum(abs(getattr(got[i], kind) - rank[h]) for i, h in enumerate(hosts)) <= 2 * RESIDUAL
    assert len({got[i].verdict for i in range(8, 30)}) == 2


ARTICLE = "<article><h1>{t}</h1><p>{p}</p><div>Read &amp; share</div><p>{q}<br>tail</p></article>"


def test_main_text():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Home</ul></nav>'
        '<!-- <p>no</p> --><div class="cookie-notice">Accept</div><article><h1>Head &amp;\n line</h1><p><b>One &lt;b&gt;.<br><p>Two  three<p>Four <i>five</i></article>'
        '<aside>x</aside><section id="comments"><p>me too</p></section><form><p>mail</p></form><footer>&copy;</footer></body>'
    )
    assert H.main_text(H.parse(page)) == "Head & line\n\nOne <b>.\n\nTwo three\n\nFour five"
    for nothing in (None, "", "<", "<p>", "<nav>x</nav>", "<script>never closed"):
        assert H.main_text(H.parse(nothing)) in ("", "<")
    assert H.main_text(H.parse("plain text")) == "plain text"
    assert H.main_text(H.parse("<p>" * 3 + "a" * 200_000)) == "a" * 200_000


def test_tree_matching():
    tree = lambda s: H.from_skeleton(H.skeleton(H.parse(s)))
    a, b = tree("<div><p>x<p>y<p>z</div>"), tree("<div><p>x<p>new<p>y<p>z</div>")
    score, pairs = H.match(a, b)
    texts = [(p.text, q.text) for p, q in pairs if p.tag == "#"]
    assert len(texts) == 3 and all(p == q for p, q in texts) and score == 1 + 1 + 3 * 3
    assert H.match(tree("<p>x"), tree("<ul><li>x</ul>"))[0] == 1


def _most_pairs(a, b):
    """The score of a best matching, by trying all."""
    if a.tag != b.tag:
        return 0

    def rows(x, y):
        if not x or not y:
            return 0
        w = _most_pairs(x[0], y[0])
        return max(rows(x[1:], y), rows(x, y[1:]), w + rows(x[1:], y[1:]) if w else 0)

    return (2 if a.tag == "#" and a.text == b.text else 1) + rows(a.kids, b.kids)


def test_tree_matching_against_brute_force():
    rng = random.Random(4)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("xyz") + "<br>"
        return f"<{(t := rng.choice(['div', 'ul']))}>" + "".join(some(depth - 1) for _ in range(rng.randrange(4))) + f"</{t}>"

    for _ in range(150):
        a, b = (H.from_skeleton(H.skeleton(H.parse(some(3) + some(2)))) for _ in "ab")
        score, pairs = H.match(a, b)
        assert score == _most_pairs(a, b) == sum(2 if p.tag == "#" and p.text == q.text else 1 for p, q in pairs)
        assert all(p.tag == q.tag for p, q in pairs)


def test_deeply_nested_page(spark):
    deep = "<div>" * 5000 + "inside" + "</div>" * 5000
    got = H.extract(pages(spark, [(i, "http://deep.org/", deep + f"<p>{i}</p>") for i in range(3)])).collect()
    assert {r.page_id: r.text for r in got} == {i: f"inside\n\n{i}" for i in range(3)}


def test_constant_slots_are_template(spark):
    rows = [(i, "http://host.org/a", ARTICLE.format(t=prose(i, 3), p=prose(i + 50, 9), q=prose(i + 90, 9))) for i in range(40)]
    rows += [(100, "http://few.org/a", ARTICLE.format(t="t", p="p", q="q")), (101, None, None), (102, None, ""), (103, "http://host.org/", "<p>other</p>"), (103, "http://host.org/", "<p>other</p>")]
    got = H.extract(pages(spark, rows)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(by[i] == f"{prose(i, 3)}\n\n{prose(i + 50, 9)}\n\n{prose(i + 90, 9)} tail" for i in range(40))
    assert by[100] == "t\n\np\n\nRead & share\n\nq tail" and by[101] == by[102] == "" and by[103] == "other"
    assert H.extract(pages(spark, [])).count() == 0


def test_escapes():
    for text in ("", "\\", *CONTROL, "".join(CONTROL), "\\<\\/s>", "a</s>b[INST]\\[/INST]", "<|en<|end|>d|>"):
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be\nkind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\ <|end|> 𝒳"), (1, 2, "assistant", "\\ <|end|> 𝒳"),
        (2, 0, "user", None), (2, 1, None, "x"), (None, None, "assistant", "lost"), (3, 5, "assistant", ""), (3, None, "user", "w " * 50_000),
        *((4, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(3000)),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in read_back(assemble(turns)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, ro or "", x or "") for c, t, ro, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        said = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.loss_chars == len(said) and r.formatted_chars > sum(len(x) for *_, x in mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert read_back(assemble(turns.limit(0))).count() == 0
