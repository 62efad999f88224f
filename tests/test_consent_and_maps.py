"""Places of consent dialogs, resources of pages, choice of sitemaps, and accuracy of the language guess."""

from pyspark.sql import functions as F

from lexatlas.operators import consent, pages
from lexatlas.operators import urls as links

TEXT = "We and our partners store cookies on this device."


def segments_of(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    return {(r["page_id"], r["text"]) for r in consent.consent_segments(df).collect()}


def test_landmarks_hold_no_dialog_themselves(spark):
    box = f"{TEXT}<button>Accept all</button>"
    got = segments_of(
        spark,
        f'<header class="cookie-bar">{box}</header>',
        f'<div class="cookie-bar" role="Banner">{box}</div>',
        f'<main class="policy"><div class="cookie-bar">{box}</div></main>',
        f'<div role="dialog">{box}</div>',
        None,
        "",
    )
    assert got == {(2, TEXT + "Accept all"), (3, TEXT + "Accept all")}


def test_named_boxes_need_a_reason(spark):
    many = "".join(f"<button>Choice {i}</button>" for i in range(7))
    got = segments_of(
        spark,
        f'<div id="modal">{TEXT}<button>OK</button></div>',
        f'<div id="modal">{TEXT}{many}</div>',
        f'<div id="modal">{TEXT}{many}<a href="/more">More</a></div>',
        f'<div id="modal">{TEXT}{many}<input type=checkbox></div>',
        f'<div id="modal" style="position: relative">{TEXT}<button>OK</button></div>',
        f'<div id="modal" data-notice="1" style="position:static">{TEXT}<button>OK</button></div>',
        f'<div id="modal">{TEXT}</div>',
        '<div id="modal">Short.<button>OK</button></div>',
        '<div id="uc-main-dialog">Short.</div>',
        '<div class="Cmp gdpr">Short.</div>',
    )
    assert {page for page, _ in got} == {0, 2, 3, 5, 8, 9}


def test_scripts_in_a_box_are_not_its_text(spark):
    got = segments_of(spark, f'<div id="cookie-box"><script>var consent = "{TEXT}"</script><style>.a {{}}</style>{TEXT}<button>OK</button></div>')
    assert got == {(0, TEXT + "OK")}


def test_resources_are_frames_and_scripts_with_a_host(spark):
    html = """<script async src="https://cdn.cookielaw.org/a.js"></script><IFRAME title=x src=//cmp.b.com/f></IFRAME><script src="/own.js"></script>
      <script>var s = 1</script><img src="https://img.quantcast.com/x.png"><iframe data-src="https://didomi.io/lazy"></iframe>"""
    df = spark.createDataFrame([(1, "https://x.com/a", html), (2, "https://y.com/", None), (3, None, "<script src='https://iubenda.com/i.js'></script>")], "page_id long, url string, html string")
    rows = consent.page_resources(df)
    assert {(r["page_id"], r["page_host"], r["resource_url"]) for r in rows.collect()} == {
        (1, "x.com", "https://cdn.cookielaw.org/a.js"), (1, "x.com", "//cmp.b.com/f"), (3, None, "https://iubenda.com/i.js"),
    }
    assert {r["vendor"] for r in consent.cmp_vendors(rows).collect()} == {"cookielaw", "cmp.", "iubenda"}


def maps_of(spark, index, page_url=None):
    robots = spark.createDataFrame([("s", "Sitemap: https://s/index.xml", page_url)], "site string, text string, page_url string")
    loc = lambda *urls: "".join(f"<url><loc> {u} </loc></url>" for u in urls)
    maps = [("https://s/index.xml", loc(*index))] + [(u, loc(u + "#page", u + ".png")) for u in index]
    got = links.sitemap_urls(robots, spark.createDataFrame(maps, "sitemap_url string, xml string"))
    return [r["url"].removeprefix("https://s") for r in got.orderBy("pos").collect()]


def test_maps_of_other_languages_are_skipped(spark):
    index = [f"https://s/{x}/sitemap.xml" for x in ("ja", "de", "en", "fr")]
    inner = [f"/{x}/sitemap.xml#page" for x in ("ja", "de", "en", "fr")]
    assert maps_of(spark, index) == inner
    assert maps_of(spark, index, "https://s/en/start") == [inner[2], inner[0]]
    assert maps_of(spark, index, "https://s/articles/start") == inner
    assert maps_of(spark, index, "https://s/") == inner


def test_other_xml_is_an_address_and_six_maps_are_read(spark):
    index = ["https://s/feed.xml", "https://s/a.html", *(f"https://s/sitemap{i}.xml" for i in range(8))]
    assert maps_of(spark, index) == ["/feed.xml", "/a.html", *(f"/sitemap{i}.xml#page" for i in range(6))]


def test_languages_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) >= 100")
    both = docs.select("doc_id", "lang").join(pages.detect_language(docs), "doc_id")
    rates = {r["lang"]: r["rate"] for r in both.groupBy("lang").agg(F.avg((F.col("lang") == F.col("detected")).cast("int")).alias("rate")).collect()}
    assert len(rates) == 4 and min(rates.values()) >= 0.9, rates


def test_languages_of_plain_sentences(spark):
    rows = {
        "it": "Non sono riuscito a trovare la risposta della quale si parla nel testo.",
        "pt": "O serviço não guarda os dados que não são usados para as compras do cliente.",
        "nl": "Het bedrijf bewaart de gegevens van een klant niet, maar zij zijn door anderen te zien.",
        "pl": "Dane są przechowywane przez firmę, która nie przekazuje ich do innych, jest to jednak możliwe.",
        "cs": "Údaje se neuchovávají, ale jsou předány jiným podle zákona, které platí pro firmu.",
        "hu": "Az adatok nem kerülnek át, de ha ez a cég kéri, akkor meg is kell adni.",
        "ro": "Datele nu sunt păstrate în cadrul firmei, care este obligată să le șteargă din sistem.",
        "tr": "Veriler şirket için çok önemlidir ve bu nedenle bir yıl gibi kısa süre sonra silinir.",
        "en": "The data is kept for a year and it is deleted by the company on request.",
        "ru": "Мы храним данные и не передаём их.", "uk": "Ми зберігаємо дані і не передаємо їх.", "bg": "Ние пазим данните и не ги предаваме.",
        "el": "Τα δεδομένα", "ja": "データを保存します", "zh": "我们保存数据", "ko": "데이터를 저장합니다",
    }
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows.items())], "doc_id long, lang string, text string")
    got = df.join(pages.detect_language(df), "doc_id").where("lang <> detected").select("lang", "detected").collect()
    assert got == []
