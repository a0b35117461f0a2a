"""Tests of what the operators are to do beyond the given tables, which hold none of these cases."""

import base64
import hashlib
import random
import textwrap

import corpus_pipeline
from tidefold.llm import license_scan, queries, repetition, url_filter

SF = "/root/testdata/sf0.001"
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen, kieleen, uskontoon, poliittiseen tai muuhun mielipiteeseen, kansalliseen tai yhteiskunnalliseen alkuperään, omaisuuteen, syntyperään tai muuhun tekijään perustuvaa erotusta. Mitään erotusta ei myöskään pidä tehdä",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Ai cũng được hưởng những quyền và tự do ghi trong bản tuyên ngôn này không phân biệt đối xử",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging.",
]


def gibberish():
    rng = random.Random(7)
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300))
    return [letters, " ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(80)), " ".join(hashlib.sha256(b"%d" % k).hexdigest() for k in range(80))]


def test_language_stage_drops_foreign_and_gibberish_texts(spark):
    docs = repetition.keep(spark.read.parquet(f"{SF}/documents.parquet"))
    bad = [(100_000 + k, t, None, "s", len(t)) for k, t in enumerate(FOREIGN + gibberish())]
    both = docs.unionByName(spark.createDataFrame(bad, "doc_id long, text string, lang string, source string, n_chars long"))
    assert repetition.keep(both).count() == both.count()  # the stage before lets all of them through
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_quality_stage_drops_repeats_that_pass_the_base_rules(spark):
    def fresh(name, n):
        return [f"{name}{k}" for k in range(n)]

    passage, long = fresh("p", 18), fresh("q", 150)
    bad = [
        passage + fresh("a", 32) + passage + fresh("b", 32),  # 36 of 100 words, under half
        [w for k in range(10) for w in fresh(f"r{k}x", 18) * 2 + fresh(f"s{k}x", 64)],  # many short repeats
        fresh("a", 50) + passage + passage + fresh("b", 30),  # longest of 18 of 116 words
        long + fresh("a", 2000) + long + fresh("b", 2000),  # 7 of 100 words, but 150 at once
    ]
    good = [fresh("a", 400), passage[:9] + fresh("a", 60) + passage[:9] + fresh("b", 60)]
    rows = [(100_000 + k, " ".join(w), "en", "s", 1) for k, w in enumerate(bad + good)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert not {r.doc_id for r in repetition.judge(both).where("base_failed").collect()} & {r[0] for r in rows}
    clean = {r.doc_id for r in repetition.judge(docs).where("not base_failed").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, both, SF).collect()}
    assert kept == clean | {100_000 + len(bad), 100_001 + len(bad)}


def test_short_notices_are_found_inside_documents(spark):
    texts = ["Copyright 2020 Somebody. ALL rights\n reserved. More words follow here", "all rights", "All rights reserved.", "all of the rights reserved", "x // SPDX-License-Identifier: MIT", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = license_scan.scan(docs, license_scan.TEMPLATES | license_scan.SHORT_NOTICES)
    got = sorted((r.doc_id, r.license, r.template_shingles, r.shared_shingles) for r in both.collect())
    assert got == [(0, "All-rights-reserved", 1, 1), (2, "All-rights-reserved", 1, 1), (4, "SPDX-MIT", 1, 1)]
    rows = queries.queries()["op7_license_scan"](spark, SF).where("license = 'All-rights-reserved'").collect()
    held = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where("text like '%All rights reserved.%'").collect()}
    assert held and {r.doc_id for r in rows} == held and len(rows) == len(held)


def test_commented_and_wrapped_license_headers_are_found(spark, tmp_path):
    def commented(name, first, each, last="", width=60):
        lines = textwrap.wrap((license_scan.TEMPLATES | license_scan.PASSAGES)[name], width)
        return "\n".join([first, *(each + x for x in lines), last, "some code()"])

    apache = "\n".join(["# Copyright 2020 Somebody", "#", *("# " + x for x in textwrap.wrap(license_scan.TEMPLATES["Apache-2.0-notice"], 70)), "#", "#     http://www.apache.org/licenses/LICENSE-2.0", "#"])
    texts = [apache, commented("MIT-permission", "/*", " * ", " */"), commented("BSD-3-endorsement", "//", "// "), commented("GPL-disclaimer", "", "-- "), "see - the ***** License", "/" * 300_000 + " " + "-" * 300_000 + "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.license) for r in queries.queries()["op7_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {(0, "Apache-2.0"), (0, "Apache-2.0-name"), (0, "Apache-2.0-notice"), (1, "MIT-permission"), (2, "BSD-3-endorsement"), (3, "GPL-disclaimer"), (3, "GPL-name")}


def test_suffix_statistics_count_all_labelled_rows(spark):
    """Also where the trees are fitted on few of the urls, and where one url has a third of all rows."""
    urls = [(f"http://a{k}.{'bad' if k % 2 else 'good'}.com/{k}", k % 2) for k in range(400)] + [("http://x.often.org/", 1)] * 200
    labelled = spark.createDataFrame(urls, "url string, bad int")
    model = url_filter.fit(labelled, most_labelled=100)
    got = {r.suffix: (r.bad, r.n) for r in model.table.collect()}
    assert got == {"com": (200, 400), "bad.com": (200, 200), "good.com": (0, 200), "org": (200, 200), "often.org": (200, 200)}
    assert (model.known.total, model.known.prior) == (600, 400 / 600)
    pages = spark.createDataFrame([(1, "http://z.bad.com/7"), (2, "http://z.good.com/8"), (3, None)], "page_id long, url string")
    rows = {r.page_id: r.verdict for r in url_filter.judge(pages, [], model).collect()}
    assert rows[1] == "block" and rows[2] == "allow" and len(rows) == 3
