import unicodedata

from hostile import documents, empty
from pyspark.sql import functions as F

from lattica.llm.language_id import SEGMENT, SEGMENTS, classify, compressors, dictionaries, fold, identify, keep_identified, learn, letters, segments, shares


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs, learn(docs, fold(4) == 2)).join(docs.select("doc_id", "lang"), "doc_id").where(fold(4) == 2)
    share, rejected = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert share > 0.97 and rejected < 0.05


def test_smallest_encoding_wins():
    import zstandard

    dicts = dictionaries({"a": [["lorem ipsum dolor sit amet " * 9]], "b": [["the quick brown fox jumps " * 9]]})
    models = compressors(dicts)
    text = "The QUICK brown fox; the quick fox jumps!"
    sizes = {}
    for lang, content in dicts:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = len(z.compress(letters(text).encode()))
    lang, score, margin = classify(text, models)
    assert lang == min(sizes, key=sizes.get) == "b" and 0 < score <= 1
    assert margin == (max(sizes.values()) - min(sizes.values())) / min(sizes.values())


def test_letters_are_of_category_l():
    text = "Ab½ ² Ⅷ c_d 日本 3x²y e\u0301 ☆"
    want = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    assert letters(text).split() == want
    assert letters("½ ² Ⅷ") == "" and classify("½ ² Ⅷ", compressors([("a", b"some words")]))[0] == "und"


def test_segments_come_from_all_over_a_text():
    text = "\n".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)} " * 80 for k in range(200))
    found = segments(text)
    assert len(found) == SEGMENTS and max(map(len, found)) <= SEGMENT
    firsts = [x[:2] for x in found]
    assert firsts[0] == "aa" and firsts == sorted(firsts) and firsts[-1] > "gg"


def test_every_sampled_document_has_its_share():
    assert shares([10, 3, 100, 50], 100) == [10, 3, 44, 43] and shares([], 5) == [] and shares([9, 9], 5) == [2, 3]
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    (_, content), = dictionaries({"x": [[f"{w}q " * 60 for _ in range(3)] for w in words]})
    assert all(f"{w}q".encode() in content for w in words) and len(content) <= 1 << 16


def test_a_repeated_line_is_kept_once_and_shared_ones_are_not():
    (_, content), (_, other) = dictionaries({"x": [["same line"], ["same line", "in both"]], "y": [["in both", "own"]]})
    assert content == b"same line" and other == b"own"


def test_hostile_documents(spark):
    docs = documents(spark, ["der die das und nicht " * 30])
    got = {r["doc_id"]: r for r in identify(docs, learn(docs)).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (0, 1, 2, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = keep_identified(docs, learn(docs))
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["rejected"] for r in identify(docs, learn(docs)).collect())


def test_nothing_to_learn_from(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(docs, learn(docs)).collect()} == {"und"}
    assert identify(empty(spark), learn(empty(spark))).count() == 0
