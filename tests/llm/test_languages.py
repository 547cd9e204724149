"""Language answers against whole texts compressed one at a time, and held-out accuracy."""

import zlib

import zstandard

from clauseloom.llm import languages, queries

from .cases import FOLDER, empty, frame, rows


def plain_sizes(text, model):
    raw, out = text.encode(), []
    for content in model.dictionaries:
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = 0
        for at in range(0, len(raw), languages.BLOCK):
            lower = "".join(chr(c) if c >= 128 else chr(c).lower() if chr(c).isalpha() else " " for c in raw[at : at + languages.BLOCK]).encode("latin-1")
            while b"  " in lower:
                lower = lower.replace(b"  ", b" ")
            p = zstandard.ZstdCompressionParameters.from_level(6, source_size=languages.BLOCK, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            size += len(zstandard.ZstdCompressor(dict_data=given, compression_params=p).compress(lower))
        out.append(size)
    return out


def test_registered_query_is_right(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = languages.train_languages(docs)
    found = {r.doc_id: r for r in queries.op12_zstd_languages(spark, FOLDER).collect()}
    right = seen = 0
    for n, r in enumerate(docs.collect()):
        got = found[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got.lang_pred, got.score, got.accepted) == ("und", 0, False)
            continue
        if n % 5 == 0:
            sizes = plain_sizes(r.text, model)
            assert got.lang_pred == model.languages[sizes.index(min(sizes))]
            low = sorted(sizes)
            assert got.margin == low[1] - low[0] and got.accepted == (got.margin >= 2)
        if got.held_out and r.lang:
            seen, right = seen + 1, right + (got.lang_pred == r.lang)
    assert len(found) == docs.count() and seen > 30 and right >= 0.95 * seen


def test_held_out_documents_teach_nothing(spark):
    docs = frame(spark, [(n, f"wort{n} und") for n in range(60)]).selectExpr("doc_id", "text", "'de' as lang")
    model = languages.train_languages(docs)
    words = set(model.dictionaries[0].decode().split())
    assert model.languages == ["de"]
    # digits are no part of words
    assert words == {"wort", "und"}
    texts = spark.createDataFrame([(n, "held" if zlib.crc32(str(n).encode()) % 4 == 2 else "open", "x") for n in range(40)], "doc_id long, text string, lang string")
    assert languages.train_languages(texts).dictionaries == [b" open "]


def test_long_words_are_learned_in_pieces(spark):
    docs = spark.createDataFrame([(1, "日本語" * 40, "ja"), (3, "word " * 9, "en"), (None, "lost", "zz"), (4, None, "yy"), (5, "none", None)], "doc_id long, text string, lang string")
    model = languages.train_languages(docs, dictionary_bytes=200)
    assert model.languages == ["en", "ja"] and all(len(d) <= 202 for d in model.dictionaries)
    pred = {r.doc_id: r.lang_pred for r in languages.identify_languages(docs, model).collect()}
    assert pred[1] == "ja" and pred[3] == "en" and pred[4] == "und"


def test_odd_rows(spark):
    model = languages.train_languages(frame(spark).selectExpr("*", "'en' as lang"))
    found = languages.identify_languages(frame(spark), model).collect()
    assert len(found) == len(rows()) and {r.lang_pred for r in found} == {"en", "und"}
    assert all((r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) for d, t in rows() for r in found if r.doc_id == d and d not in (None, 4, 5))
    nothing = languages.train_languages(empty(spark).selectExpr("*", "'en' as lang"))
    assert {r.lang_pred for r in languages.identify_languages(frame(spark), nothing).collect()} == {"und"}
    assert languages.identify_languages(empty(spark), model).count() == 0
