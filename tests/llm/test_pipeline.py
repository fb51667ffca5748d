import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from railyard.llm import bpe, chat, decontaminate, fingerprints, jaccard, licences, quality, secrets, sharding, wordpiece
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import redacted


def tables(spark, folder):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("aeioustnrl", k=rnd.randint(2, 8))) for _ in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=25))) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        body, grade = rnd.choices(words, k=rnd.randint(60, 200)), rnd.choice([0, 1, 2, 2, 2])
        if grade == 0:
            body = [w.upper() + "!!" for w in body]
        if grade == 1:
            body = [rnd.choice(["idiot", "scum"]) if rnd.random() < 0.1 else w for w in body]
        text = " ".join(body)
        if i % 17 == 3:
            text += " " + items[i % 5][1].replace("a", "e", 1)
        if i % 13 == 2:
            text = f'{text[:50]} token = "{rnd.randbytes(20).hex()}" {text[50:]}'
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    for i in range(300, 330):
        body = docs[rnd.randrange(300)][1].split(" ")
        body[rnd.randrange(len(body))] = "edited"
        docs.append((i, " ".join(body), "en", "src0", None))
    docs += [(330, None, None, None, None), (331, "", "en", "x", 0), (331, "", "en", "x", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_pipeline_like_brute_force(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows = sorted([d for d in docs if model.tails(quality.features(d[1]))[-1] >= quality.KEEP])
    heads = brute([d[1] for d in rows])
    rows = [d for k, d in enumerate(rows) if heads[k][0] == k]
    matcher = decontaminate.Matcher([(i, decontaminate.normalise(t)) for i, t in items])
    rows = [d for d in rows if not matcher.matches(d[1])]
    own = bpe.codec(corpus_pipeline.VOCABULARY)
    assert sorted(out) == [d[0] for d in rows] and 60 < len(rows) < 250
    models = secrets.train(spark.createDataFrame([d[:2] for d in rows], "doc_id long, text string"))
    for i, text, lang, source, _ in rows:
        assert (out[i].lang, out[i].source, bytes(out[i].ids)) == (lang, source, own.encode(redacted(text, models)))
    assert any(redacted(d[1], models) != d[1] for d in rows)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert empty.schema == docs.schema or [f.name for f in empty.schema] == docs.columns


def test_redaction_changes_n_chars_only_there(spark):
    rows = [(1, "a password=abcdef123456 b", "en", "s", 7), (2, "plain", "en", "s", 99), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, docs, "").collect()}
    assert (out[1].text, out[1].n_chars) == ("a [REDACTED] b", 14)
    assert (out[2].n_chars, out[3].text, out[3].n_chars) == (99, None, None)
    assert secrets.KINDS and jaccard.N_WORDS == 5


CLASHING = ["found", "base", "p_good", "expected_grade", "key", "__key", "__hits", "hits", "before", "__token", "head", "set", "label", "ids", "grade", "Found_", "__hash", "__Slot", "__row", "__point", "__rank", "__from", "__rest", "__hit0", "__hit1"]


def test_columns_and_ids_of_any_kind_survive(spark, tmp_path):
    docs, _ = tables(spark, tmp_path)
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    string_id = lambda df, c="doc_id": df.withColumn(c, F.concat(F.lit("id "), F.lpad(F.col(c).cast("string"), 6, "0")))
    odd = string_id(plain).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    string_id(spark.read.parquet(f"{tmp_path}/labels.parquet")).write.parquet(f"{tmp_path}/odd/labels.parquet")
    string_id(spark.read.parquet(f"{tmp_path}/benchmark.parquet"), "item_id").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, f"{tmp_path}/odd")
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(f"id {r.doc_id:06}" for r in stage(spark, plain, str(tmp_path)).collect())
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)

    model = quality.train(plain, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    vocabulary, pieces = corpus_pipeline.VOCABULARY, public_tokenizers.path("piece_bpe_32k.model")
    operators = {
        "bpe": (lambda d: bpe.encode(d, vocabulary, decoded_col="decoded"), {"ids"}),
        "sharding": (lambda d: sharding.assign(d, 24, keep=d.columns).drop("size", "text_crc32", "shard", "slot"), set()),
        "licences": (licences.scan, set()), "fingerprints": (fingerprints.fingerprint, set()), "jaccard": (jaccard.dedupe, set()),
        "decontaminate": (lambda d: decontaminate.clean(d, string_id(spark.read.parquet(f"{tmp_path}/benchmark.parquet"), "item_id")), set()),
        "quality": (lambda d: quality.score(d, model), {"p_good", "expected_grade"}), "wordpiece": (lambda d: wordpiece.count_tokens(d, pieces), set()),
        "secrets": (secrets.scan, {"found", "base"}),
    }
    for name, (operator, replaced) in operators.items():
        rows = operator(odd).collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING if c not in replaced), name
    turns = odd.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", *CLASHING)
    assert chat.read_back(chat.format_turns(chat.canonical_turns(turns))).count() == plain.select("doc_id").distinct().count()
    assert fingerprints.neighbour_edits(odd).count() == len(docs) == jaccard.join(odd).count()
