"""URL queues, CSV scans and page triage."""

import pytest
from pyspark.sql import functions as F

from postwatch.functions import html, urls
from postwatch.operators import pages, queue
from postwatch.plans import triage
from postwatch.sinks import crawl, runs
from postwatch.sources import queue_csv


def test_csv_scan_keeps_order_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,job_url,note\n1,http://a,"two\nlines"\n2,"http://b,c","say ""x"""\n3\n\n4,,end\n', encoding="utf-8")
    got = [tuple(r) for r in queue_csv.scan(spark, str(path), multi_line=True).select("pos", "id", "job_url", "note").orderBy("pos").collect()]
    assert got == [
        (0, "1", "http://a", "two\nlines"), (1, "2", "http://b,c", 'say "x"'), (2, "3", None, None), (3, "4", None, "end")
    ]


def test_row_index_over_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,job_url\n" + "".join(f"{i},http://x.org/{i}\n" for i in range(5000)))
    (tmp_path / "b.csv").write_text("n,job_url\n" + "".join(f"{i},http://y.org/{i}\n" for i in range(700)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        scanned = queue_csv.scan(spark, str(tmp_path), multi_line=False)
        assert scanned.rdd.getNumPartitions() > 1
        assert scanned.where("CAST(n AS long) <> pos").count() == 0
        counts = {r["source_file"][-5:]: r["count"] for r in scanned.groupBy("source_file").count().collect()}
        assert counts == {"a.csv": 5000, "b.csv": 700}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_positional_scan_keeps_the_index_over_all_rows(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("id,anything\n1\n2,\n3,https://a.b/c?d=1\n")
    got = queue_csv.positional(queue_csv.scan(spark, str(path)))
    assert [tuple(r) for r in got.collect()] == [(2, "https://a.b/c?d=1")]
    named = got.select(urls.path_key(F.col("url"), ""), urls.indexed_key(F.col("url"), F.col("pos"))).first()
    assert tuple(named) == ("https___a.b_c_d=1.html", "page_2_https___a_b_c_d_1.html")


def test_url_column_is_the_first_named_so():
    assert queue.url_column(["id", "Site_Link", "job_url"]) == "Site_Link"
    with pytest.raises(ValueError):
        queue.url_column(["id", "name"])


def test_filter_links(spark):
    table = spark.createDataFrame(
        [("1", "https://LinkedIn.com/x"), ("2", "https://a.linkedin.com/x"), ("3", "https://x.org/?u=indeed.com"), ("4", None), (None, None)],
        "id string, link string",
    )
    assert [r.id for r in queue.filter_links(table).orderBy("id").collect()] == [None, "1", "4"]


def test_a_queue_of_two_files_is_taken_file_by_file(spark):
    rows = [("b.csv", 0, "b0"), ("a.csv", 0, "a0"), ("a.csv", 1, "a1"), ("b.csv", 1, "a0")]
    table = spark.createDataFrame(rows, "source_file string, pos long, job_url string").repartition(3)
    nothing = spark.createDataFrame([], "job_url string")
    batch = queue.next_batch(table, nothing, 2)
    assert sorted(r.job_url for r in batch.collect()) == ["a0", "a1"]
    triaged = spark.createDataFrame([("a0", "p"), ("a1", ""), ("b0", "q")], "url string, html_file_path string")
    found = queue.results(table, triaged, table).collect()
    assert sorted((r.source_file, r.pos, r.job_url) for r in found) == [("a.csv", 0, "a0")] * 2 + [("a.csv", 1, "a1"), ("b.csv", 0, "b0")]


QUEUE = [(0, "a", "x"), (1, "b", "x"), (2, "a", "y"), (3, "c", "x"), (4, None, "x"), (5, "d/job", "x"), (6, "a", "z")]


def test_copies_count_toward_the_batch_and_go_together(spark):
    rows = spark.createDataFrame(QUEUE, "pos long, job_url string, note string")
    done = spark.createDataFrame([("c",)], "job_url string")
    assert [r.pos for r in queue.next_batch(rows, done, 3).collect()] == [0, 1, 2]
    assert [r.pos for r in queue.next_batch(rows, done, 9, marker="/job").collect()] == [5]
    left = queue.remaining(rows, spark.createDataFrame([("a",), ("a",)], "job_url string"))
    assert sorted(r.pos for r in left.collect()) == [1, 3, 4, 5]


def test_hot_url_gives_the_same_rows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"u{i}", "n") for i in range(600)], "pos long, job_url string, note string")
    for done in (["hot"], ["u0", "u3"], []):
        table = spark.createDataFrame([(d,) for d in done], "job_url string")
        plain = sorted(r.pos for r in queue.unprocessed(rows, table).collect())
        assert plain == [i for i in range(600) if ("hot" if i % 3 else f"u{i}") not in done]
        assert sorted(r.pos for r in queue.unprocessed(rows, table, hot_rows=50).collect()) == plain


def page(title="ok", body="text"):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("size", [None, 100])
def test_triage_pass(spark, size):
    rows = spark.createDataFrame(QUEUE, "pos long, job_url string, note string")
    done = spark.createDataFrame([("c",)], "job_url string")
    stored = spark.createDataFrame(
        [("a", page()), ("b", page("Job Not Found")), ("c", page()), ("unasked", page())], "url string, html string"
    )
    out = triage.triage_pass(rows, done, stored, "dir", size=size)
    judged = {r.url: (r.keyword, r.html_file_path) for r in out.triaged.collect()}
    assert judged == {"a": (None, "dir/a.html"), "b": ("not found", "")}
    results = sorted(tuple(r) for r in out.results.select("pos", "job_url", "note", "html_file_path").collect())
    assert results == [(0, "a", "x", "dir/a.html")] * 3 + [(1, "b", "x", "")]
    assert sorted(r.pos for r in out.remaining.collect()) == [3, 4, 5]
    assert [tuple(r)[:2] for r in out.store.select("url", "html_file_path", "html").collect()] == [("a", "dir/a.html")]
    counts = queue.counts(rows, done, out.newly).first().asDict()
    assert counts == {"n_before": 1, "n_new": 2, "n_processed_total": 3, "n_queue": 7, "n_remaining": 3}


def test_required_element_and_challenge_pages(spark):
    wanted = '<div class="x" id="jobDescriptionText">t</div>'
    stored = spark.createDataFrame(
        [
            ("1", page(body=wanted)), ("2", page(body='<div id="other">')), ("3", page("Just a moment...", wanted)),
            ("4", page("by CloudFlare", wanted)), ("5", page(body=wanted + "<div id='cf-challenge'>")),
            ("6", page(body=wanted + '<iframe width=1 src="https://challenges.cloudflare.com/x">')),
            ("7", page(body='<div data-id="jobDescriptionText">')), ("8", page("error", "<DIV ID=jobDescriptionText>")),
            ("9", page("just a moment...", wanted)),
        ],
        "url string, html string",
    )
    out = pages.triage(stored, "d", required=("div", "jobDescriptionText"))
    assert sorted(r.url for r in pages.store_rows(out).collect()) == ["1", "8", "9"]
    assert sorted(r.url for r in out.where("is_challenge").collect()) == ["3", "4", "5", "6"]


@pytest.mark.parametrize(
    ("text", "keyword"),
    [
        (page("Job Not Found"), "not found"), (page("Seite NICHT gefunden"), "nicht gefunden"), (page(body="ABGELAUFEN"), "abgelaufen"),
        (page(body="entfernt, not found"), "not found"), (page(), None), (page(body="Das ist nicht mehr VERFÜGBAR"), "nicht mehr verfügbar"),
    ],
)
def test_first_keyword_in_list_order(spark, text, keyword):
    frame = spark.createDataFrame([(text,)], "h string")
    got = frame.select(html.first_keyword(F.col("h"), html.title(F.col("h")), html.ERROR_KEYWORDS)).first()[0]
    assert got == keyword


def test_titles(spark):
    cases = {"<title>a\n  b </title>": "a b", "<TITLE lang=x>Q</Title><title>R</title>": "Q", "<p>none": ""}
    frame = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r.html: r.title for r in pages.titles(frame).collect()} == cases


def test_path_collisions(spark):
    stored = spark.createDataFrame([("a?b", page()), ("a:b", page()), ("c", page())], "url string, html string")
    assert [tuple(r) for r in pages.path_collisions(pages.triage(stored, "d")).collect()] == [("d/a_b.html", 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a,b", 'say "x"\nnow'), (1, "c", None)], "pos long, job_url string, note string")
    crawl.write_csv(rows.select("job_url", "note"), str(tmp_path / "csv"))
    back = queue_csv.scan(spark, str(tmp_path / "csv" / "*.csv"), multi_line=True)
    assert sorted((r.job_url, r.note or "") for r in back.collect()) == [("a,b", 'say "x"\nnow'), ("c", "")]
    with pytest.raises(ValueError):
        crawl.write_remaining(rows, "/x/q/", "/x/q")
    crawl.write_remaining(rows, "/x/q", str(tmp_path / "rest"))
    assert queue_csv.scan(spark, str(tmp_path / "rest"), multi_line=True).count() == 2
    results = rows.withColumn("html_file_path", F.lit(""))
    for run in ("1", "2", "2"):
        crawl.append_results(results, str(tmp_path / "results"), run)
    assert runs.read_runs(spark, str(tmp_path / "results"), results.schema).count() == 4
    crawl.append_results(results, str(tmp_path / "results_csv"), "1", csv=True)
    stored = spark.createDataFrame([("u", page())], "url string, html string")
    crawl.append_pages(pages.store_rows(pages.triage(stored, "d")), str(tmp_path / "pages"), "1")
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 1
