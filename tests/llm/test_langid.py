import unicodedata

import pytest
import zstandard
from pyspark.sql import functions as F

from citeweave.llm import langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs.where(held), langid.fit_dictionaries(docs.where(~held)))
    got = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.fixture(scope="module")
def dictionaries(docs):
    return langid.fit_dictionaries(docs)


def test_edges(docs, no_docs, dictionaries):
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(docs, dictionaries).collect()]
    assert {(p, x) for d, p, x in got if d in (1, 2, 3)} == {("und", True)} and len(got) == docs.count()
    assert {p for d, p, _ in got if d == 6} == {"fr"}
    assert langid.identify(no_docs, dictionaries).count() == 0
    assert langid.fit_dictionaries(no_docs) == {} and {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


def test_keep_identified(docs, dictionaries):
    kept = langid.keep_identified(docs, dictionaries)
    assert kept.columns == docs.columns
    assert not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def plain(text, dictionaries):
    """Language and margin by fresh compressors on every call, with nothing kept between texts."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    words, run = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            run += c
        else:
            words, run = words + [run], ""
    data = " ".join(w for i, w in enumerate(words) if w or i in (0, len(words) - 1)).encode()
    if unicodedata.category(text.lower()[-1])[0] not in "LM" and not data.endswith(b" "):
        data += b" "
    for level, sure in zip(langid.LEVELS, (*langid.SURE, -1)):
        sizes = []
        for lang, d in sorted(dictionaries.items()):
            coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(coder.compress(data[i : i + langid.BLOCK_BYTES])) for i in range(0, len(data), langid.BLOCK_BYTES)), lang))
        sizes.sort()
        margin = 1 - sizes[0][0] / sizes[1][0]
        if margin > sure:
            break
    return sizes[0][1], margin


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    dictionaries = langid.fit_dictionaries(docs)
    want = {r["doc_id"]: plain(r["text"], dictionaries) for r in docs.collect()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(docs, dictionaries).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 and got[k][2] == (want[k][0] == "und" or want[k][1] < langid.MIN_MARGIN) for k in want)


def test_letters_are_letters(dictionaries):
    coders = langid.compressors(dictionaries)
    assert {langid.classify(t, coders) for t in ("½ 12", "² ³", "Ⅷ", "_ -", "٣")} == {("und", 0.0)}
    assert all(langid.classify(t, coders)[0] != "und" for t in ("½ a", "日", "ß", "ก"))


def test_query_on_null_ids(spark, tmp_path, docs):
    from citeweave.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_language_id(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and {r["held_out"] for r in got if r["doc_id"] is None} == {False}


def test_whole_text_decides():
    coders = langid.compressors({"a": b"the cat and the dog " * 50, "b": b"le chat et le chien " * 50})
    text = "zzz qqq " * 10 + "le chat et le chien " * 400
    assert langid.classify(text, coders)[0] == "b" and langid.classify("1234 !!", coders) == ("und", 0.0)
    assert langid.classify("any words", langid.compressors({"a": b"any words"})) == ("a", 1.0)


def test_no_language_goes_unlearned(spark):
    """Rows that share an id, or are one text, are not all left out of the sample together."""
    de = [f"der kleine Hund Nummer {i} läuft über die lange Straße nach Hause" for i in range(900)]
    en = [(1000 + i, f"the small dog number {i} runs along the road to its house", "en") for i in range(900)]
    for shared in range(6):
        for rows in ([(shared, t, "de") for t in de], [(shared, de[0], "de")] * 900):
            found = langid.fit_dictionaries(spark.createDataFrame(rows + en, "doc_id long, text string, lang string"))
            assert sorted(found) == ["de", "en"] and all(found.values())
