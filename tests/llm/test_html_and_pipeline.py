"""Main text of pages, and the pipeline's stages against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from crawlscan.llm import html_extract as H
from test_duplicates import expected
from test_rules_and_mixing import brute_targets, counts
from test_text_models import plain_spans
from crawlscan.llm import minhash, mixing, quality_rules, secret_scan

NONE = frozenset()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("plain &lt;text&gt; &#233;&amp;", "plain <text> é&"),
        ("<p>a\n  b<p>c<br>d<b>e</b>f", "a b c def"),
        ("<head><title>t</title><style>p{}</style></head><body><script>if(a<b){'</p>'}</script><p>x</p>", "x"),
        ("<nav>menu</nav><header>site</header><article><header><h1>T</h1></header><p>one<p>two</article><footer>f</footer>", "T one two"),
        ("<main><p>a</p><aside>b</aside><form>c<input></form><div class='ad-box'>d</div><section id=comments>e</section></main>rest", "a"),
        ("<div class='page with-sidebar'><div class=content><p>a</div><div id=sidebar>b</div></div>", "a"),
        ("<article class='comment'>c</article><article>post</article>", "post"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
        ("<ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><p>The text with <a href=x>a link</a> in it</p>", "The text with a link in it"),
        ("a<!-- c --><![CDATA[d]]>b<!doctype x>", "ab"),
        ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
        ("unclosed <b and more", "unclosed"),
        ("<div class=comments>only this</div>", "only this"),
        ("a&nbsp;b&copy c", "a b© c"),
        ("<script>var a=\"<!--\";</script><p>one</p><p>two</p></body>", "one two"),
        ("<script>x() // don't</script><p>it's one</p><p>two</p>", "it's one two"),
        ("<style>p:after{content:'\"'} /* isn't <!-- */</style><article><p>it's one</p><script>'<p>'</script><p>two</p></article>", "it's one two"),
        ("<p class='share-price'>Shares at 12</p>", "Shares at 12"),
        ("<article><p>a</p><div class=related-work>b</div><div class='related-posts'>c</div><div id=article-comments-2>d</div></article>", "a b"),
        ("<p>a</p><p><a href=/r>The full report</a></p><p>b</p><div><a href=/1>One</a> <a href=/2>Two</a></div>", "a The full report b"),
        ("<a href=it's>x</a><p title=\"a > b\">y</p><b title='>'>z</b>", "x y z"),
        ("<div id=Site_Header>a</div><div class='wide header'><article><div class=header>b</div><p>c</article></div>", "b c"),
        ("<p class=market-share>a<p class=cookie-notice>b<p class='notice box'>c<div class=google-ads>d</div>", "a"),
    ],
)
def test_rules(page, text):
    assert H.main_text(page, NONE) == text


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 5000 + "deep", NONE) == "deep"
    assert len(H.main_text("<p>word " * 50_000, NONE)) == 50_000 * 5 - 1


def site(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"https://a.example.com/{k}", f"<div class=x1>Welcome to our site, read on</div><div class=x2><p>Story {k} has its own words {k * 7}</p></div><div class=x3>All that is left {k % 2}</div>"))
    rows += [(100 + k, "https://b.example.com/", "<div class=x1>Welcome to our site, read on</div><div class=x2><p>Same page</p></div>") for k in range(9)]
    rows += [(200, None, None), (201, "no host", ""), (202, "https://c.example.com/1", "<div class=x1>Alone</div>")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")


def test_repeated_branches_of_a_site_go(spark):
    got = {r["page_id"]: r for r in H.extract(site(spark)).collect()}
    for k in range(12):
        assert got[k]["text"] == f"Story {k} has its own words {k * 7}"
    assert all(got[100 + k]["text"] == "Welcome to our site, read on Same page" for k in range(9))  # copies are one page
    assert (got[200]["text"], got[201]["text"], got[202]["text"]) == ("", "", "Alone")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == 24
    assert H.extract(site(spark).limit(0)).count() == 0


def extracted(spark, pages, host="a.example.com"):
    rows = [(k, f"https://{host}/{k}", page) for k, page in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_tree_judges_articles(spark):
    """A notice that repeats in articles goes; a body beside a teaser's article stays, other text there goes."""
    notice = "<div class=x4>Written for you by our friends</div>"
    got = extracted(spark, [f"<article><h1>Title {k}</h1><p>Story {k}</p>{notice}</article><div class=x5>All that is left</div>" for k in range(12)])
    assert got == {k: f"Title {k} Story {k}" for k in range(12)}
    body = [f"Body {k} has its own words {k * 7}" for k in range(12)]
    got = extracted(spark, [f"<div class=x5>All that is left</div><div class=x2>{b}</div><article>Teaser {k}</article>" for k, b in enumerate(body)])
    assert got == {k: f"{b} Teaser {k}" for k, b in enumerate(body)}


def test_importance_equals_brute_force(spark):
    """Which nodes go or stay, by entropies computed from lists of each node's contents and layouts."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        parts = [f"<div class=x{j}>{rng.choice('abcdefgh'[: 1 + j])}{'<p>p' * rng.randrange(j % 3 + 1)}</div>" for j in range(8) if rng.random() < 0.8]
        inside = "".join(f"<div class=y{j}>{rng.choice('stuvwxyz'[: 1 + j])}</div>" for j in range(8) if rng.random() < 0.8)
        rows.append((f"h{k % 3}", "".join(parts) + f"<article>{inside}<p>text {k}</article>" * (k % 2)))
    shows, marks = {}, {}
    for host, page in rows:
        by_node, found = {}, list(H.blocks(H.parse(page)))
        for b in found:
            by_node.setdefault((b.key, b.inside), []).append(b.text)
            marks.setdefault((host, b.key), set()).add("inside" if b.inside else "beside" if any(x.inside for x in found) else "")
        digest = H.copy_digest([(b.key, b.text) for b in found])
        for (key, inside), texts in by_node.items():
            shows.setdefault((host, key), set()).add((digest, inside, tuple(texts)))
    entropy = lambda xs: -sum(n / len(xs) * math.log(n / len(xs)) for n in Counter(xs).values())
    want = set()
    for (host, key), seen in shows.items():
        m = len(seen)
        if m < 2:
            continue
        content, layout = (entropy([f(t) for _, _, t in seen]) / math.log(m) for f in (lambda t: t, len))
        lack = (1 - content) * (1 - layout / 2) * (m - 1) / (m + 1)
        if 1 - lack * (0.75 if "inside" in marks[host, key] else 1) < 0.5:
            want.add((host, key, True))
        elif "beside" in marks[host, key] and 0.75 * (1 - lack) >= 0.5:
            want.add((host, key, False))
    got = {tuple(r) for r in H.judged_nodes(spark.createDataFrame(rows, "host string, html string"), 0.5).collect()}
    assert got == want and {True, False} == {noise for *_, noise in got}


def test_near_copies_of_a_page_count_once(spark):
    """Copies that differ in adverts, comments, scripts or a small counter keep their body; other pages of the host still tell its template."""
    near = "<script>track({k})</script><!-- ad {k} --><div class=ad>Advert {k}</div><div class=x2>One body with quite some words of its own</div>"
    body = "One body with quite some words of its own"
    assert extracted(spark, [near.format(k=k) for k in range(4)]) == dict.fromkeys(range(4), body)
    assert extracted(spark, [near.format(k=k) + f"<p>{k}</p>" for k in range(4)]) == {k: f"{body} {k}" for k in range(4)}
    top = "<div class=x1>Welcome to our site, read on</div>"
    story = [f"Story {k} has its own words {k * 7}" for k in range(12)]
    got = extracted(spark, [top + near.format(k=k) for k in range(88)] + [f"{top}<div class=x2>{s}</div>" for s in story])
    assert got == {k: body if k < 88 else story[k - 88] for k in range(100)}
    assert H.main_text("<div>all of it</div>", frozenset(key for key, *_ in H.blocks(H.parse("<div>all of it</div>")))) == "all of it"


def test_text_that_outweighs_an_article_stays():
    body = "A body of many words. " * 20
    assert H.main_text(f"<div>{body}</div><article>Teaser</article>", NONE) == f"{body}Teaser"
    assert H.main_text(f"<div>Aside</div><article>{body}</article>", NONE) == body.strip()


def test_given_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in H.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = (re.sub(r"<[^>]+>", "", b) for b in re.split(r"</?(?:p|h1)>", inner))
        import html

        assert got[r["page_id"]] == " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).collect() if r["kept"]}
    one = stages[0](spark, docs, SF)
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == kept

    two = stages[1](spark, docs, SF)
    part = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert two.schema == docs.schema and sorted(r["doc_id"] for r in two.collect()) == sorted(set(part.values()))

    three = stages[2](spark, docs, SF)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert three.columns == docs.columns
    for r in three.collect():
        assert r["text"] == secret_scan.redacted(text[r["doc_id"]]) and r["n_chars"] == len(r["text"])

    four = stages[3](spark, docs, SF)
    copies = {r["doc_id"]: -(-r["taken"] // max(1, r["size"])) for r in mixing.mix(docs).collect()}
    got = {}
    for r in four.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert four.columns == docs.columns and got == {k: n for k, n in copies.items() if n}

    five = stages[4](spark, four, SF).collect()
    assert sum(r["n_words"] for r in five) == sum(len(text[k].split()) * n for k, n in got.items())


def test_run_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ("doc_id", "piece", "n_words")
    assert sorted(tuple(r[c] for c in key) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r[c] for c in key) for r in docs.collect())


def test_run_equals_brute_force(spark, tmp_path):
    """All stages in plain Python over a fixture, with nulls, ties and repeated rows; the packing by its rules."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 90))) for _ in range(50)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "hot", "hot", None]), len(t)) for k, t in enumerate(base)]
    for k in range(40):
        w = base[k % 20].split()
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + k, " ".join(w) + (" password=hunter2hunter2" if k % 4 == 0 else ""), "en", rng.choice(["a", "b"]), 0))
    rows += [(200, None, "en", "a", None), (201, "", None, None, 0), (202, "x y " * 40, "en", "b", 160), (203, base[3], "en", "b", 0), (203, base[3], "en", "b", 0), (204, base[5].upper(), "en", "hot", 0)]
    rows += [(300, " ".join(f"v{k}" for k in range(70)), "fr", "hot", 1)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    kept = [r for r in rows if (c := counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0]]  # 20 labels certify no cutoff
    component = expected([(r[0], r[1]) for r in kept], 5)
    kept = [r for r in kept if component[r[0]] == r[0]]
    clean = []
    for k, text, lang, source, _ in kept:
        for a, _, b in sorted(plain_spans(text), reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        clean.append((k, text, source))
    sizes = Counter()
    for _, text, source in clean:
        sizes[source] += len(text.split())
    target, times = brute_targets(dict(sizes), (3, 1, 2), 1.5, 2.0), Counter()
    for source in sizes:
        own = []
        for k, text, s in clean:
            if s == source:
                u = (int(hashlib.md5(f"{k}:mix-1".encode()).hexdigest()[:13], 16) + 1) / 2**52
                weight = 1 / (1 + 20 * sum(c in "#*$%&|<>" for c in text) / len(text))
                own.append((min(int((1 - u ** (1 / weight)) * 2**52), 2**52 - 1), str(k), k, len(text.split())))
        epochs, left = divmod(round(target[source]), sizes[source])
        repeats, at = Counter(x[2] for x in own), 0
        for group in itertools.groupby(sorted(own), key=lambda x: x[:2]):
            members = list(group[1])
            size = sum(m[3] for m in members)
            some = at + size <= left or (at < left and (left - at) // len(members) > 0)
            times[members[0][2]] += repeats[members[0][2]] * (epochs + some)
            at += size
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces, n_words = Counter(), {k: len(t.split()) for k, t, _ in clean}
    for r in got:
        assert r["piece"] == 0 and r["n_words"] == n_words[r["doc_id"]]
        pieces[r["doc_id"]] += 1
    assert pieces == Counter({k: n for k, n in times.items() if n})
    bins = {}
    for r in got:
        bins.setdefault((r["block"], r["bin"]), []).append(r)
    source = {k: s for k, _, s in clean}
    for b in bins.values():
        assert sum(r["n_words"] for r in b) <= 2048 and len({r["doc_id"] for r in b}) == len(b) and max(Counter(source[r["doc_id"]] for r in b).values()) <= 4
