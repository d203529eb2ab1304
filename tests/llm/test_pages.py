"""URL filter, page text, registry, SQL twins and the pipeline."""

import os
import subprocess
import sys

import duckdb
import pytest
from llm.helpers import prose

import corpus_pipeline
import gate
from tallyhouse.llm import html, html_labels, registry, urls

SMALL = "/root/testdata/sf0.001"


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, text in urls.RULES:
        domain, slash, tail = text.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + tail) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return host, path, *(best or (None, None))


def test_rules_by_brute_force(spark):
    given = [
        None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://x.net", "http://x.net?a/b", "http://net/", "http://xnet/",
        "https://b.org/fr/1", "https://org/fr", "https://m.example.com/de/#x", "ftp://É.com/ü?://q", "http://a.b.example.net/en/", "x://y://z.net/", "http://x.net/\n?a", "http://x.net/" + "p" * 3000,
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(given)], "page_id long, url string, host string")
    found = urls.judge(pages, urls.ruled(pages, urls.RULES), urls.RULES).orderBy("page_id").collect()
    for r, u in zip(found, given, strict=True):
        host, path, rule, verdict = brute_rule(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.where("false"), urls.ruled(pages, urls.RULES), urls.RULES).count() == 0
    empty = urls.judge(pages, urls.ruled(pages.where("false"), urls.RULES), [])
    assert {r.verdict for r in empty.collect()} == {"allow"}


def test_regression_learns_the_labels(spark):
    rows = spark.createDataFrame([(f"http://{'shop' if k % 2 else 'news'}{k}.example/{'buy' if k % 2 else 'story'}/{k}", k % 2) for k in range(120)], "url string, blocked int")
    weights, intercept = urls.fit(rows.where("blocked = 1 OR url LIKE '%story%'"))
    fresh = spark.createDataFrame([(k, f"http://{'shop' if k % 2 else 'news'}x{k}.example/{'buy' if k % 2 else 'story'}/{k * 7}") for k in range(40)], "page_id long, url string")
    odds = fresh.select("page_id", urls.log_odds(*urls.host_and_path(fresh.url), weights, intercept).alias("odds")).collect()
    assert sum((r.odds > 0) == bool(r.page_id % 2) for r in odds) >= 38


def test_scoring_plan_has_no_python(spark, capsys):
    urls.query(spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


MODEL = html.Model(html_labels.pages())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>One &amp; two&nbsp;<b>three</b>\n four<p>five", "One & two three four\n\nfive"),
        ("<main><h1>A</h1><p>Hello there my friends of the wide world.</p><aside><p>A side note of some length that goes on.</p></aside></main>", "A\n\nHello there my friends of the wide world."),
        ('<nav><a href="/">Home</a></nav><article><h1>T</h1><p>x <a href="y">y</a> z</p></article><div class="ad">Buy</div><footer>c</footer>', "T\n\nx y z"),
        ("<article><p>a<script>var t='</p>'</script>b<style>p{}</style></p><!-- no --><![if x]></article>", "ab"),
        ('<div class="post"><h2>T</h2><p>one</p></div><section class="comments"><p>I disagree with this text, because it is wrong.</p></section>', "T\n\none"),
        ("<article><p>open <i>tags<li>item", "open tags\n\nitem"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, MODEL) == text


def test_self_closing_icons_hide_nothing_behind_them():
    page = html.Page("<article><svg/><p>one</p><math/><svg><path/><g/></svg><p>two</p></article>")
    assert [t for block in page.blocks for _, t in block] == ["one", "two"] and not page.hidden


def test_marginals_equal_enumeration():
    from itertools import product
    from math import exp, prod

    page = html.Page('<div class="menu"><p>a b c</p><a href="x">l</a></div><p>text</p>')
    n = len(page.tags)
    total, content = 0.0, [0.0] * n
    for states in product((0, 1), repeat=n - 1):
        s = (1, *states)
        own = prod(exp(sum(MODEL.emit[f][s[k]] for f in page.features(k) if f in MODEL.emit)) for k in range(1, n))
        move = prod(MODEL.move.get(page.tags[k], MODEL.move[""])[s[page.parents[k]]][s[k]] for k in range(1, n))
        total += own * move
        content = [c + own * move * x for c, x in zip(content, s, strict=True)]
    assert MODEL.marginals(page) == pytest.approx([c / total for c in content])


def test_pages_table(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html.extracted(pages).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html.extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_sql_twins(spark, key):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    frame = registry.QUERIES[key](spark, SMALL)
    found = duck.execute(registry.ORACLES[key])
    assert gate.compare(frame.columns, frame.collect(), [d[0] for d in found.description], found.fetchall()) == ""


def test_pipeline_stages_take_effect(spark, tmp_path):
    long = prose(1, 120)
    clean = [(k, prose(200 + k, 90), "en", "s", 1, "k") for k in range(20)]
    item = prose(900, 30)
    rows = [*clean, (50, None, None, None, None, None), (51, "12 34", "en", "s", 1, "k"), (52, long, "en", "s", 1, "k"), (53, long + " end", "en", "s", 1, "k"), (54, long, "en", "s", 1, "k"), (54, long, "en", "s", 1, "k"), (55, prose(990, 50) + " " + " ".join(long.split()[:40]), "en", "s", 1, "k"), (56, item + " " + prose(991, 40), "en", "s", 1, "k")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        ids.append(sorted({r.doc_id for r in docs.select("doc_id").collect()}))
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        if name == "substring_dedup":
            left = {r.doc_id: r for r in docs.collect()}
    kept = list(range(20))
    assert ids == [[*kept, *range(52, 57)], [*kept, 52, 55, 56], [*kept, 52, 55, 56], [*kept, 52, 55], [*kept, 52, 55]]
    assert left[55].text == prose(990, 50) and left[55].n_chars == len(left[55].text)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).columns) == 7


def test_imports_without_this_subpackage(tmp_path):
    """A copy of the repository without the subpackage still lists its other queries."""
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr




@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><table><tr><td data-label="Price">Ten pounds of it</td></tr></table><p data-label>Two</p></article>', "Ten pounds of it\n\nTwo"),
        ("<article><p>a<!-- x --!> b<!--> c<!---> d</p></article>", "a b c d"),
    ],
)
def test_foreign_marks_and_comments(page, text):
    assert html.main_text(page, MODEL) == text


def test_deep_nesting_takes_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert html.main_text("<article>" + "<div><p>" * n + "word" + "</div>" * n + "</article>", MODEL) in ("", "word")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_copies_of_one_url_do_not_fill_the_sample(spark, monkeypatch):
    """With room for a few urls only, 500 copies of a blocked one leave the allowed ones in."""
    monkeypatch.setattr(urls, "MAX_LABELLED", 20)
    hot = [("http://shop0.example/buy/0", 1)] * 500
    rest = [(f"http://{'shop' if k % 2 else 'news'}{k}.example/{'buy' if k % 2 else 'story'}/{k}", k % 2) for k in range(60)]
    weights, intercept = urls.fit(spark.createDataFrame(hot + rest, "url string, blocked int"))
    fresh = spark.createDataFrame([("http://news900.example/story/9",), ("http://shop901.example/buy/9",)], "url string")
    odds = [r[0] for r in fresh.select(urls.log_odds(*urls.host_and_path(fresh.url), weights, intercept)).collect()]
    assert odds[0] < 0 < odds[1]
