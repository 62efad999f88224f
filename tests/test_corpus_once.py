"""clean_corpus reads its pages once, with the same choice of texts."""

import json

from pyspark.sql import functions as F

from lexatlas.plans import pipelines

PROSE = "We keep personal data of visitors for a year and tell everyone who asks us what we know. "


def test_pages_are_read_once(spark):
    words = [PROSE + f"This is page {w} of the terms. " + PROSE * 4 for w in ("one", "two", "three", "four")]
    rows = [
        (1, "https://a.example.com/1", 200, "text/html", f"<body><p>{words[0]}</p></body>"),
        (2, "https://a.example.com/2", 200, "text/html", f"<body><p>{words[0]}</p></body>"),  # repeats 1
        (3, "https://a.example.com/3", 200, "text/html", f"<body>x<script>var a = {json.dumps(words[1])};</script></body>"),  # text in a script
        (4, "https://a.example.com/4", 404, "text/html", f"<body><p>{words[2]}</p></body>"),
        (5, "https://a.example.com/5", 200, "text/html", "<body>thin</body>"),
        (6, "https://a.example.com/6", 200, "text/html", None),
        (7, "https://a.example.com/1#top", 200, "text/html", f"<body><p>{words[3]}</p></body>"),  # the address of 1
    ]
    reads = spark.sparkContext.accumulator(0)

    def read(html):
        reads.add(1)
        return html

    crawl = spark.createDataFrame(rows, "page_id long, url string, status int, content_type string, html string")
    docs, lost = pipelines.clean_corpus(crawl.withColumn("html", F.udf(read, "string").asNondeterministic()("html")))
    assert {(r["doc_id"], r["chosen"], r["lang"]) for r in docs.collect()} == {(1, "static", "en"), (3, "payload", "en")}
    assert {(r["doc_id"], r["reason"]) for r in lost.collect()} == {(2, "not_prose_or_repeated"), (4, "http_error"), (5, "too_thin"), (6, "too_thin"), (7, "not_prose_or_repeated")}
    assert reads.value == len(rows)
