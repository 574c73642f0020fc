import numpy as np
import pytest

from strata.llm import langid

SCHEMA = "doc_id long, text string, lang string, language string, score string"
EN, DE = "the quick brown fox jumps over the lazy dog and runs away from it", "der schnelle braune fuchs springt über den faulen hund und läuft weg davon"


def phrases(text: str, sample: str, symbol: np.ndarray) -> int:
    """Brute force: the longest match in the sample, again and again."""
    shown = lambda t: bytes(langid.to_symbols([t], symbol)[0].tolist())
    inside, whole, n, i = shown(sample), shown(text), 0, 0
    while i < len(whole):
        j = i + 1
        while j < len(whole) and whole[i : j + 1] in inside:
            j += 1
        i, n = j, n + 1
    return n


def learned(text: str, symbol: np.ndarray) -> str:
    """The part of a sample that isn't kept back."""
    n, upto = len(langid.to_symbols([text], symbol)[0]), len(text)
    while len(langid.to_symbols([text[:upto]], symbol)[0]) > n - n // 10:
        upto -= 1
    return text[:upto]


def test_phrases_equal_brute_force(monkeypatch):
    model = langid.Model.fit({"de": [DE], "en": [EN]})
    texts = [EN, DE, "Fox über dog!", "", "qqq zzz 123", "漢字 fox", "läuft" * 300, (EN + " " + DE) * 20, EN * 40, "the quick brown fox " * 200]
    known = [learned(x, model.symbol) for x in (DE, EN)]
    want = [[phrases(t, x, model.symbol) for x in known] for t in texts]
    assert model.phrases(texts).tolist() == want
    monkeypatch.setattr(langid, "STRETCH", 7)  # phrases are longer than stretches, too
    assert model.phrases(texts).tolist() == want


def made(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables, rnd.integers(1, 4))) for _ in range(n))


def test_texts_in_no_learned_language_go(spark):
    """Four languages of syllables over the same letters; two are learned."""
    rnd = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    tongues = [["".join(rnd.choice(letters, 3)) for _ in range(25)] for _ in range(4)]
    rows = [(i, made(rnd, tongues[i % 2], 120), "xy"[i % 2], "", "") for i in range(80)]
    strange = [(100 + i, made(rnd, tongues[2 + i % 2], 120), None, "", "") for i in range(20)] + [(200 + i, " ".join("".join(rnd.choice(letters, 5)) for _ in range(120)), None, "", "") for i in range(10)]
    short = [(300 + i, made(rnd, tongues[i % 2], 3), None, "", "") for i in range(20)]
    kept = {r.doc_id for r in langid.keep_known(spark.createDataFrame(rows + strange + short, SCHEMA)).collect()}
    assert kept == {r[0] for r in rows + short}


def docs(spark, more=()):
    rows = [(i, (EN if i % 2 else DE)[i % 20 :] * 3, "en" if i % 2 else "de", "x", "y") for i in range(60)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


def test_identify(spark):
    odd = [(100, None, "en", "", ""), (101, "", "en", "", ""), (102, "12 !!", "de", "", ""), (103, EN, None, "", ""), (None, DE, None, "", ""), (1, EN, "en", "", ""), (104, DE * 3000, None, "", "")]
    out = langid.identify(docs(spark, odd)).collect()
    assert len(out) == 67
    by = {r.doc_id: r for r in out if r.doc_id != 1}
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and by[100].score == 0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[104].lang_pred == "de"
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") and 0.5 < by[i].score <= 1 for i in range(2, 60))


def test_rows_kept_and_empty_tables(spark):
    odd = [(100, None, "en", "", ""), (102, "12 !!", "de", "", ""), (103, "это другой язык", None, "", ""), (104, "漢字仮名 ok", None, "", ""), (105, "The.", None, "", ""), (106, EN + " 漢字", None, "", "")]
    kept = langid.keep_known(docs(spark, odd))
    assert {r.doc_id for r in kept.collect()} == {*range(60), 105, 106} and kept.columns == ["doc_id", "text", "lang", "language", "score"]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, EN, None, "", "")], SCHEMA)
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_languages_of_many_letters(spark):
    """Two languages of 400 letters each beside English: none of their letters is lost, and their texts stay."""
    rnd = np.random.default_rng(4)
    words = {lang: ["".join(chr(c) for c in rnd.integers(first, first + 400, 3)) for _ in range(150)] for lang, first in (("zh", 0x4E00), ("ko", 0xAC00))}
    rows = [(1000 + 100 * k + i, "".join(rnd.choice(words[lang], 40)), lang, "x", "y") for k, lang in enumerate(words) for i in range(40)]
    given = docs(spark, rows)
    assert {r.doc_id for r in langid.keep_known(given).collect()} == {*range(60), *(r[0] for r in rows)}
    wanted = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == wanted[r.doc_id] for r in langid.identify(given).collect() if r.doc_id in wanted)
    model = langid.Model.fit({lang: [r[1] for r in rows if r[2] == lang] for lang in words})
    letters = sorted(set("".join(r[1] for r in rows)))
    assert len({tuple(langid.to_symbols([c], model.symbol)[0].tolist()) for c in letters}) == len(letters) > 400
    found = model.phrases([rows[0][1] + "x"])[0].tolist()
    assert found == [phrases(rows[0][1] + "x", learned("\n".join(r[1] for r in rows if r[2] == lang), model.symbol), model.symbol) for lang in ("ko", "zh")]


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) > 100
