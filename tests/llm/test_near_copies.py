"""The pipeline's near copies against a comparison of all pairs of shingle sets."""

import random


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def survivors(rows, least=0.8):
    """The least ids of groups tied by the similarity of five-word shingles, by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = text.lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= least * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {root(i) for i, _ in sets}


def test_pipeline_near_copies_like_all_pairs(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(5)
    texts = [words(rng, 4) for _ in range(1500)]
    for n in (5, 8, 30, 90):
        for _ in range(12):
            base = words(rng, n).split()
            texts.append(" ".join(base))
            for _ in range(6):
                base = list(base)
                for _ in range(rng.randint(0, 3)):
                    base[rng.randrange(n)] = words(rng, 1)
                texts.append(" ".join(base).title() if rng.random() < 0.3 else "  ".join(base))
    texts += ["a a a a a", "a a a a a a", "", "\n", "b", "B"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == survivors(rows)
    assert pipeline.near_duplicate_stage(spark, df.limit(0), "").count() == 0
    nulls = spark.createDataFrame([(None, "x y"), (None, "X  y"), (3, "same id, one"), (3, "same id, two")], df.schema)
    assert pipeline.near_duplicate_stage(spark, nulls, "").count() == 3


def test_pairs_to_verify_stay_few_in_a_family_of_copies(spark, monkeypatch):
    """Copies of one text with a word or two replaced: about as many pairs as texts are verified, whatever the partitions."""
    import corpus_pipeline as pipeline
    from strandlake.llm import shingles

    rng = random.Random(11)
    base = words(rng, 200).split()
    rows = []
    for i in range(600):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(1, 2)):
            copy[at] = words(rng, 1)
        rows.append((i, " ".join(copy)))
    counts, verified = [], shingles.verified

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "verified", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == survivors(rows) and sum(counts) <= 4 * len(rows)
    assert not hasattr(pipeline, "verified_duplicates")  # fingerprints, which changed no result, are not taken


def test_pairs_to_verify_stay_few_in_a_family_tied_in_chains(spark, monkeypatch):
    """Copies with one word replaced are tied where their places are the same or adjacent: no text stands for all, and nearest ones
    tie them before all pairs are weighed."""
    import corpus_pipeline as pipeline
    from strandlake.llm import shingles

    rng = random.Random(12)
    base = words(rng, 60).split()
    rows = [(i, " ".join([*base[:at], words(rng, 1), *base[at + 1 :]])) for i in range(800) for at in [rng.randrange(60)]]
    counts, verified = [], shingles.verified

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "verified", counted)
    got = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert set(got) == survivors(rows) and sum(counts) <= 6 * len(rows)


def test_texts_that_share_passages_become_pairs_not_rows(spark, monkeypatch):
    """Long texts that share three quarters of their words in groups of 20 meet in many shingles: they are counted by pair, and no
    pair of them is compared by its whole sets."""
    import corpus_pipeline as pipeline
    from strandlake.llm import shingles

    rng = random.Random(13)
    texts = []
    for _ in range(12):
        shared = words(rng, 750)
        texts += [f"{shared} {words(rng, 250)}" for _ in range(20)]
    texts += [f"{t} {words(rng, 60)}" for t in texts[:5]]
    rows = list(enumerate(texts))
    crowded, sets, divided, of_texts = [], [], shingles.divided, shingles.of_texts

    def told(found, least, few=0):
        parts = divided(found, least, few)
        crowded.append(parts.where("shingle is not null").count())
        return parts

    def counted(texts, width, wanted, value, column, *rest):
        out = of_texts(texts, width, wanted, value, column, *rest)
        if column == "items":
            sets.append(out.count())
        return out

    monkeypatch.setattr(shingles, "divided", told)
    monkeypatch.setattr(shingles, "of_texts", counted)
    monkeypatch.setattr(shingles, "FEW_PAIRS", 0)
    got = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert set(got) == survivors(rows) and crowded and not any(crowded)
    assert sum(sets) <= 40


def test_pairs_that_share_passages_never_outnumber_rows(spark, monkeypatch):
    """Texts in groups of 30 that share most words meet in many shingles: whatever the partitions, no more rows come out of the step that
    counts their pairs than went in."""
    import corpus_pipeline as pipeline
    from strandlake.llm import shingles

    rng = random.Random(15)
    texts = []
    for _ in range(4):
        shared = words(rng, 340)
        texts += [f"{shared} {words(rng, 60)}" for _ in range(30)]
    texts += [f"{t} {words(rng, 20)}" for t in texts[::11]]
    rows = list(enumerate(texts))
    made, divided = [], shingles.divided

    def told(found, *rest):
        parts = divided(found, *rest)
        made.append((found.count(), parts.count()))
        return parts

    monkeypatch.setattr(shingles, "divided", told)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == survivors(rows) and made and all(out <= rows_in for rows_in, out in made)


def test_only_rows_in_doubt_are_moved(spark, monkeypatch):
    """Texts that no other is like stay where they are."""
    import corpus_pipeline as pipeline

    rng = random.Random(14)
    rows = [(i, words(rng, 40)) for i in range(400)] + [(i % 50, f"copy {i % 50}") for i in range(100)] + [(None, "x y"), (None, "X y"), (7, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    moved, text_keys = [], pipeline.text_keys

    def counted(docs, node_col, wanted=None):
        out = text_keys(docs, node_col, wanted=wanted)
        moved.append(out.count())
        return out

    monkeypatch.setattr(pipeline, "text_keys", counted)
    out = pipeline.near_duplicate_stage(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in out) == sorted([*range(400), *range(50), 7])
    assert sum(moved) == len(rows) and min(moved) < 150
