"""Token counts, license scans, languages, quality and pieces against plain versions, and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import registry
from strandlake.llm.language_id import codewords, fit_languages, held_out, identify_languages, keep_languages
from strandlake.llm.licenses import PHRASES, TEMPLATES, LicenseAutomaton, scan_licenses
from strandlake.llm.pieces import PieceModel, decode_pieces, encode_pieces
from strandlake.llm.quality import fit_resampler, keep_quality, kth_largest, sample_quality
from strandlake.llm.token_counts import count_tokens

ODD = ["", None, " ", "a", "A b", "\n\n", "é", "漢字 テスト", "x" * 5000, "word " * 3000, "▁ literal marker", "tab\tand  two", "<|endoftext|> x", "3 4\x1c5 ! ?", "under the MIT license"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, n_tokens long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and columns, repeated rows, extra columns with the names of results."""
    rows = [(i, t, None if i % 3 else "en", None, None, "x", -1.0, -1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "no id", "en", None, None, None, None, None)], SCHEMA)


def test_op10_counts_like_the_library(spark, documents, odd):
    from tokenizers import Tokenizer

    path = registry.tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for df in (documents, odd):
        rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
        expected = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"].encode()), n := len(plain.encode(r["text"], add_special_tokens=False)), n > 512) for r in rows)
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, path).collect())
        assert got == expected
    assert count_tokens(documents.limit(0), path).count() == 0


def places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), found


def test_op5_phrases_like_a_plain_search(spark, documents, odd):
    extra = spark.createDataFrame([(1, "CC-BY-NC, under the MIT license; cc by nc cc by nc!"), (2, "Apache License, Version 2.0 under_the mit license")], "doc_id long, text string")
    for df in (documents, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), extra):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in scan_licenses(df).collect():
            n, found = places(texts[r["doc_id"]])
            at = [i for i, _ in found]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(at, default=None), max(at, default=None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op5_spans_of_templates(spark):
    mit = TEMPLATES["mit"][0]
    broken = mit.split()
    broken[10] = "XX"
    rows = [(1, "intro words " + mit.title() + " end"), (2, " ".join(broken)), (3, " ".join(mit.split()[:9])), (4, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and (got[1]["spans"][0]["first_word"], got[1]["spans"][0]["last_word"]) == (2, 1 + len(mit.split()))
    assert got[2]["labels"] == "mit" and got[2]["score"] < 1 and got[3]["labels"] == "" and got[4]["labels"] == "gpl-3"


def test_op5_matching_statistics():
    automaton = LicenseAutomaton(TEMPLATES, PHRASES)
    texts = [t.replace("*", " ").split() for ts in TEMPLATES.values() for t in ts] + [p.split() for p in PHRASES]
    parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(1)
    for _ in range(40):
        words = []
        for _ in range(6):
            t = rng.choice(texts)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randrange(1, 9)]
        for k, (n, _) in enumerate(automaton.statistics([automaton.vocabulary[w.encode()] for w in words])):
            assert n == max(m for m in range(k + 2) if not m or tuple(words[k + 1 - m : k + 1]) in parts)


def test_op3_held_out_accuracy_and_odd_rows(spark, documents, odd):
    model = fit_languages(documents.where(~held_out()))
    got = identify_languages(documents.withColumn("held_out", held_out()), model, carry=("held_out",)).join(documents.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out and lang_pred = lang").count() >= 0.97 * got.where("held_out").count() > 0
    rows = {r["doc_id"]: r for r in identify_languages(odd, model).collect()}
    assert len(rows) == len(ODD) + 1 and identify_languages(odd, model).count() == odd.count()
    assert all((rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(ODD))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert fit_languages(odd.where("lang is null")) is None
    assert {r["lang_pred"] for r in identify_languages(odd, None).collect()} == {"und"}
    assert identify_languages(odd.limit(0), model).count() == 0


def test_op3_prediction_uses_the_text_only(documents):
    model = fit_languages(documents.where(~held_out()))
    blind = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in identify_languages(df, model).collect())
    assert key(blind) == key(documents)


@pytest.mark.parametrize("classes", [2, 3, 4, 5, 9, 30])
def test_op3_codewords_differ(classes):
    code = codewords(classes).astype(int)
    apart = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
    assert min(apart) >= (1 if classes == 2 else 2) and (np.abs(code.sum(0)) < classes).all()


def test_op3_like_a_plain_decoder(spark, documents):
    """Counts, bit classifiers, losses and scores of the whole small table by loops over the same codewords."""
    import math
    from collections import Counter

    def grams(text):
        """Counts by (order, bucket) of 1-, 2- and 3-grams of bytes; runs of other bytes than letters are one blank."""
        data = (text or "").lower().encode()
        folded = []
        for b in data:
            b = b if 97 <= b <= 122 or b >= 128 else 32
            if not (b == 32 and folded and folded[-1] == 32):
                folded.append(b)
        out = Counter()
        for n, size in ((1, 256), (2, 4096), (3, 8192)):
            for i in range(len(folded) - n + 1):
                code = int.from_bytes(bytes(folded[i : i + n]), "big")
                out[n, code if n == 1 else (code * 2654435761) % 2**32 >> (33 - size.bit_length())] += 1
        return out

    held = {r["doc_id"]: r["h"] for r in documents.select("doc_id", held_out().alias("h")).collect()}
    rows = documents.collect()
    counts = {r["doc_id"]: grams(r["text"]) for r in rows}
    by_lang = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] and r["text"] is not None:
            by_lang.setdefault(r["lang"], Counter()).update(counts[r["doc_id"]])
    langs = sorted(by_lang)
    code = codewords(len(langs)).tolist()
    sizes = {1: 256, 2: 4096, 3: 8192}
    total = {(x, n): sum(c for (m, _), c in by_lang[x].items() if m == n) + 0.5 * sizes[n] for x in langs for n in sizes}
    model = fit_languages(documents.where(~held_out()))
    got = {r["doc_id"]: r for r in identify_languages(documents, model).collect()}

    def margin(bit, k):
        ones, others = ([(by_lang[x][k] + 0.5) / total[x, k[0]] for x, w in zip(langs, code, strict=True) if w[bit] == s] for s in (1, -1))
        return math.log(sum(ones) / len(ones)) - math.log(sum(others) / len(others))

    weights = {}
    for d, found in list(counts.items())[:80]:
        for k in found:
            if k not in weights:
                weights[k] = [margin(bit, k) for bit in range(len(code[0]))]
        sums = [sum(c * weights[k][bit] for k, c in found.items()) / 6 for bit in range(len(code[0]))]
        loss = [sum(math.log1p(math.exp(-abs(m * s))) + max(0.0, -m * s) for m, s in zip(sums, word, strict=True)) for word in code]
        best = min(range(len(langs)), key=lambda i: loss[i])
        if got[d]["lang_pred"] != "und":
            assert got[d]["lang_pred"] == langs[best]
            assert abs(got[d]["score"] - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-6


def test_op3_many_languages(spark):
    """Twelve invented languages that differ in which letters follow which."""
    rng = random.Random(4)
    follow = [{a: rng.choices("abcdefghijklmnopqrstuvwxyz", k=5) for a in "abcdefghijklmnopqrstuvwxyz"} for _ in range(12)]

    def text(k):
        words = []
        for _ in range(40):
            word = rng.choice("abcdefghijklmnopqrstuvwxyz")
            for _ in range(rng.randint(2, 8)):
                word += rng.choice(follow[k][word[-1]])
            words.append(word)
        return " ".join(words)

    rows = [(i, text(i % 12), f"x{i % 12:02}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_languages(df, fit_languages(df.where(~held_out()))).join(df.select("doc_id", "lang"), "doc_id").where(held_out())
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 0


def test_op3_keep_languages(spark, documents, odd):
    model = fit_languages(documents.where(~held_out()))
    more = documents.union(odd.select(documents.columns)) if set(documents.columns) <= set(odd.columns) else documents
    more = more.withColumns({"lang_pred": F.lit(0), "score": F.lit("s"), "Lowered": F.lit(True), "letters": F.array(F.lit(1))})
    kept = keep_languages(more, model)
    told = identify_languages(more, model).where("lang_pred <> 'und' and not ambiguous")
    assert kept.columns == more.columns and sorted(map(str, kept.select("doc_id").collect())) == sorted(map(str, told.select("doc_id").collect()))
    assert keep_languages(odd, None).count() == odd.count() and keep_languages(more.limit(0), model).count() == 0


def test_op2_keeps_clean_texts(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = registry.table(spark, big, "documents"), registry.table(spark, big, "labels")
    model, keyed = fit_resampler(docs, labels)
    kept = {r["doc_id"] for r in keyed.where(F.col("key") >= model.cut).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [d for d, q in quality.items() if q == 1]
    bad = [d for d, q in quality.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.15 * len(bad)
    assert {r["doc_id"] for r in keep_quality(docs, model).collect()} == kept
    assert keep_quality(docs, model).columns == docs.columns


def plain_buckets(text):
    """Buckets of all tokens and pairs of a text, computed token by token with whole numbers."""
    import re

    def spread(h):
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) % 2**64
        return h ^ (h >> 32)

    hashes = []
    for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode()):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in token)
        hashes.append(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(low)) % 2**64)
    pairs = [spread((x * 0x9E3779B97F4A7C15 + y) % 2**64) % 2**14 + 2**14 for x, y in zip(hashes, hashes[1:], strict=False)]
    return [spread(h) % 2**14 for h in hashes] + pairs


def test_op2_like_a_plain_model_and_sample(spark, documents, sf_dir):
    """Counts, ratios, weights, keys and the sample of the whole small table by loops; only the noise comes from Spark."""
    import math
    from collections import Counter

    from strandlake.llm.quality import gumbel

    labels = registry.table(spark, sf_dir, "labels")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    noise = {r["doc_id"]: r["g"] for r in documents.select("doc_id", gumbel("doc_id", 11).alias("g")).collect()}
    grams = {d: plain_buckets(t) for d, t in texts.items()}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if quality.get(d) == 1:
            target.update(g)
    ratio = {}
    for half in (0, 1):
        mine = [b for b in raw if (b >= 2**14) == bool(half)]
        r_all, t_all = sum(raw[b] for b in mine), sum(target[b] for b in mine)
        for b in mine:
            ratio[b] = math.log((target[b] / t_all + 0.5 * raw[b] / r_all) / 1.5 / (raw[b] / r_all))
    weight = {d: 256 * sum(ratio[b] for b in g) / (len(g) + 16) for d, g in grams.items() if g}
    n, good = len(quality), sum(q == 1 for q in quality.values())
    p, zz = good / n, 1 / n
    share = (p + zz / 2 + (p * (1 - p) * zz + zz * zz / 4) ** 0.5) / (1 + zz)
    key = {d: w + noise[d] for d, w in weight.items()}
    kept = sorted(key, key=lambda d: -key[d])[: math.ceil(share * len(weight))]
    got = {r["doc_id"]: r for r in sample_quality(documents, labels).collect()}
    assert set(got) == set(kept) and 0 < len(kept) < len(key)
    assert all(abs(r["log_weight"] - weight[d]) < 1e-4 and abs(r["key"] - key[d]) < 1e-4 and r["n_grams"] == len(grams[d]) for d, r in got.items())


def test_op2_extra_columns_and_no_labels(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    more = odd.withColumns({"Noise": F.lit(1), "log_weight": F.lit("x"), "n_grams": F.lit(None).cast("int"), "key": F.lit(2.0)})
    model, _ = fit_resampler(more, labels)
    kept = keep_quality(more, model)
    assert kept.columns == more.columns and 0 < kept.count() <= more.count()
    assert fit_resampler(odd, labels.limit(0))[0] is None
    assert keep_quality(odd, None).count() == odd.count()


def test_op2_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = sample_quality(odd, labels, keep=6)
    assert got.columns == ["doc_id", "log_weight", "n_grams", "key"] and got.count() >= 6
    assert not {0, 1, 2} & {r["doc_id"] for r in got.collect()}
    assert sample_quality(odd.limit(0), labels).count() == 0
    assert {r["doc_id"] for r in sample_quality(odd, labels.limit(0)).collect()} == {r["doc_id"] for r in fit_resampler(odd, labels)[1].where("n_grams > 0").collect()}


def test_op2_selection_is_exact(spark):
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [1.0] * 50, [5.0, *([2.0] * 30), 1.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for k in (1, 7, 31, len(values)):
            assert kth_largest(df, "x", k, fan=16) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_op4_best_segmentation_and_round_trip(spark, documents, odd):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = registry.tokenizer("piece_bpe_32k.model")
    model = PieceModel.load(path)
    with open(path, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1  # unigram, with this model's scores
    score = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    for i, piece in enumerate(proto.pieces):
        piece.score = score.get(i, piece.score)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for df in (documents, odd):
        got = decode_pieces(encode_pieces(df, model, carry=("text",)), model).collect()
        assert len(got) == df.count()
        for r in got:
            assert r["decoded"] == (r["text"] or "") and r["n_pieces"] == len(r["pieces"])
            if r["text"] and "▁" not in r["text"] and len(r["text"]) < 5000:
                total = lambda ids: sum(score.get(i, 0.0) for i in ids)
                assert abs(total(r["pieces"]) - total(library.encode(r["text"]))) < 0.02
    assert encode_pieces(documents.limit(0), model).count() == 0


def test_op4_viterbi_like_a_plain_one():
    rng = random.Random(4)
    surface = sorted({"".join(rng.choices("ab é", k=1)) + "".join(rng.choices("abé", k=rng.randint(0, 3))) for _ in range(60)})
    surface = [s.encode() for s in surface]
    scores = np.log(np.array([rng.random() for _ in surface]))
    model = PieceModel(surface, np.arange(300, 300 + len(surface), dtype=np.int32), scores, np.arange(256, dtype=np.int32))
    value = dict(zip(surface, scores.tolist(), strict=True))
    unknown = scores.min() - 10

    def best(text):
        chars, out = list(text), [0.0]
        for j in range(1, len(chars) + 1):
            options = [out[i] + value[p] for i in range(j) if (p := "".join(chars[i:j]).encode()) in value]
            if chars[j - 1].encode() not in value:
                options.append(out[j - 1] + unknown)
            out.append(max(options, default=-np.inf))
        return out[-1]

    units = [" " * rng.randint(0, 1) + "".join(rng.choices("abéxz", k=rng.randint(1, 12))) for _ in range(200)]
    for unit, raw in zip(units, model.segment([u.encode() for u in units]), strict=True):
        ids = np.frombuffer(raw, np.int32).tolist()
        total, pending = 0.0, b""
        for i in ids:
            if i >= 300:
                total += scores[i - 300]
            else:
                pending += bytes([i])
        total += unknown * len(pending.decode())
        assert abs(total - best(unit)) < 1e-9
