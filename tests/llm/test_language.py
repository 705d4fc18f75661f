"""Language identification against plain zstandard, and any number of languages."""

import random

import zstandard as zstd

from tidewatch.llm import language_id

DOCS = "doc_id bigint, text string, lang string, hash int, n string"


def words(seed, n, letters):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(60)]
    return " ".join(rnd.choices(pool, k=n))


def plain_sizes(text, dictionaries):
    """Each block of a text by a compressor of its own, made the plain way."""
    sizes = []
    for data in dictionaries.values():
        params = zstd.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, write_content_size=False, write_checksum=False)
        made = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        blocks = [text[at : at + language_id.BLOCK].encode() for at in range(0, len(text), language_id.BLOCK)]
        sizes.append(sum(len(zstd.ZstdCompressor(dict_data=made, compression_params=params).compress(b)) for b in blocks))
    return sizes


def test_predictions_follow_plain_sizes(spark):
    alphabets = {"xa": "abcdefgh", "xb": "ijklmnop", "xc": "qrstuvwx", "xd": "αβγδεζηθ"}
    labelled = [(i, words(f"{lang}{i % 5}", 80, letters), lang) for lang, letters in alphabets.items() for i in range(20)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in labelled], DOCS)
    learned = language_id.learn(frame)
    texts = [words(f"{lang}{k}", n, letters) for lang, letters in alphabets.items() for k, n in ((1, 3), (7, 40), (9, 400))]
    texts += [words("xa1", 20, "abcdefgh") + words("xb1", 20, "ijklmnop"), "z", "long " * 30_000, None, "", " 12 !", texts[0], texts[0]]
    got = language_id.identify(spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(texts)], DOCS), learned, ["doc_id"]).collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        sizes = plain_sizes(text, learned)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        other = min(s for k, s in enumerate(sizes) if k != best)
        assert row["lang_pred"] == list(learned)[best]
        assert abs(row["score"] - min(1.0, 0.5 + 5 * (other - sizes[best]) / other)) < 1e-12
        assert row["rejected"] == ((other - sizes[best]) / other < language_id.MARGIN)


def test_every_language_is_learned_and_predicted(spark, monkeypatch):
    """Many languages share the bytes of all dictionaries; the rarest is as good as any."""
    monkeypatch.setattr(language_id, "ALL_BYTES", 300 * 2048)
    labelled = [(i, words(f"l{k}", 60, "abcdefghij"), f"l{k:03d}") for k in range(300) for i in range(1 if k == 299 else 3)]
    labelled.append((0, None, "l000"))
    learned = language_id.learn(spark.createDataFrame([(*r, 1, "x") for r in labelled], DOCS))
    assert len(learned) == 300 and all(len(d) <= 2048 for d in learned.values()) and list(learned)[-1] == "l299"
    asked = spark.createDataFrame([(k, words(f"l{k}", 60, "abcdefghij"), None, 1, "x") for k in (0, 150, 201, 299)], DOCS)
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(asked, learned, ["doc_id"]).collect()} == {k: f"l{k:03d}" for k in (0, 150, 201, 299)}
    monkeypatch.setattr(language_id, "BROADCAST_LANGUAGES", 10)
    assert language_id.learn(spark.createDataFrame([(*r, 1, "x") for r in labelled], DOCS)) == learned
