"""Edges of the corpus operators: seams of long texts, blocks of the benchmark, large ids, null keys, clashing names, pairs of terms."""

import random

import numpy as np
import pytest

import corpus_pipeline
from inkwell.llm import decontaminate, fertility, language, line_dedup, near_duplicates, source_mix, substring_dedup, toxicity, warc
from tests.llm.test_corpus_operators import texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_seam_of_long_texts(monkeypatch):
    """Every start of a text that is taken in parts has one anchor run, and the same anchor as in one part."""
    rng = random.Random(5)
    data = np.array([rng.randrange(97, 101) for _ in range(5_000)], np.uint8)
    whole = substring_dedup.anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(substring_dedup, "_INDEX_BITS", 10)
    parts = substring_dedup.anchors(data, np.array([0, len(data)]))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(parts[2], parts[3], strict=True)])
    assert starts.tolist() == list(range(len(data) - 99))
    assert starts.tolist() == np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[2], whole[3], strict=True)]).tolist()


def test_long_text_keeps_what_does_not_repeat(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(30_000))
    got = substring_dedup.dedup_substrings(spark.createDataFrame([(1, text), (2, text[100:400])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(1, 0, 0), (2, 300, 1)]


def test_benchmark_blocks_keep_rows(spark):
    text = "alpha beta gamma delta"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(20)] + [(50, "beta gamma")], "item_id long, text string")
    for block in (32_000_000, 40):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], [(m.item_word, m.doc_word, m.words) for m in r.matches]) for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect())
        assert got == [("1", 4, 2, [50], [(0, 1, 2)]), ("1", 4, 2, [50], [(0, 1, 2)]), ("None", 2, 0, [], []), ("None", 4, 2, [50], [(0, 1, 2)])]


def test_longest_matches(spark):
    """Overlapping windows are one match; a word of the benchmark elsewhere is none."""
    item = [f"w{i}" for i in range(30)]
    doc = ["x", *item[5:25], "y", "w3"]
    got = decontaminate.find_contamination(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).first()
    assert (got.n_hit, got.hit_words) == (20, list(range(1, 21)))
    assert [(m.item_id, m.item_word, m.doc_word, m.words) for m in got.matches] == [(9, 5, 1, 20)]


def test_archive_of_large_ids(spark):
    payload = "p" * 200
    rows = [(2**60 + 3, "u", payload), (2**60 + 1, "u", payload), (None, "u", "short")]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect())
    assert got == [(str(2**60 + 1), "response", None), (str(2**60 + 3), "revisit", 2**60 + 1), ("None", "response", None)]


def test_null_key_is_not_held_out(spark):
    got = spark.createDataFrame([(None,)], "doc_id long").select(language.held_out("doc_id", 5, 0).alias("h")).first()
    assert got.h is False


def test_sample_of_a_language(spark):
    """No more than per_language rows of each language are learned from, and all of a rare one."""
    rows = [(i, f"der die das {i % 7}", "de") for i in range(300)] + [(1000 + i, "the of and", "en") for i in range(5)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert set(model.languages) == {"de", "en"}


@pytest.mark.parametrize("extra", [("removed", "lines_gone"), ("copy", "times"), ("key_of_mix", "doc_of_lines")])
def test_stages_with_clashing_names(spark, extra):
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), "x", "y") for i, t in texts().items()]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra[0]} string, {extra[1]} string")
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert lines.columns == docs.columns and lines.count() == docs.count() and lines.where(f"{extra[0]} = 'x'").count() == docs.count()
    mixed = source_mix.apply_mix(docs)
    assert mixed.columns[:-1] == docs.columns and mixed.columns[-1] == ("copy_2" if "copy" in extra else "copy")
    assert mixed.write.format("noop").mode("overwrite").save() is None
    assert near_duplicates.drop_near_duplicates(docs).columns == docs.columns


def test_stages_without_rows_or_counts(spark):
    """Stages take tables without n_chars, and empty ones."""
    docs = spark.createDataFrame([(1, "one two three four five six\none two three four five six", "s")], "doc_id long, text string, source string")
    assert corpus_pipeline.drop_repeated_lines(spark, docs, "").first().text == "one two three four five six"
    none = docs.where("false")
    assert corpus_pipeline.drop_repeated_lines(spark, none, "").count() == corpus_pipeline.drop_near_duplicates(spark, none, "").count() == corpus_pipeline.mix_sources(spark, none, "").count() == 0


def test_penalty_makes_groups_alike(spark):
    """Toxic sentences mention one group more often: without the penalty its neutral mention scores higher, with it alike."""
    rng, rows = random.Random(1), []
    for i in range(400):
        toxic = int(i % 2 and i % 10 < 8 or i % 20 == 0)
        words = rng.choices(["stupid", "nice", "hate"] if toxic else ["nice", "quiet", "happy", "green"], k=4)
        rows.append((i, f"{'women' if i % 2 else 'men'} {' '.join(words)}", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    apart = []
    for fairness in (0.0, toxicity.FAIRNESS):
        model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), fairness=fairness)
        a, b, worst = model.score(toxicity.features_of(["women are here", "men are here", "women hate stupid"]))
        apart.append(abs(a - b))
        assert worst > 0.9
    assert apart[0] > 0.2 and apart[1] < 0.02


def test_pairs_without_sentences(spark):
    """A pair that no labelled sentence has gets its counterfactual from a template, over the features its terms share with others."""
    rows = [(i, "immigration stupid hate" if i % 2 else "citizenry nice calm", i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    ask = toxicity.features_of(["immigrant", "citizen"])
    apart = [float(np.ptp(toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), pairs=(("immigrant", "citizen"),), fairness=f).score(ask))) for f in (0.0, 20.0)]
    assert apart[1] < apart[0] / 5


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(3) for _ in range(rng.randrange(1, 45))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.randrange(1, 45))]
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b))] = rng.randrange(3)
        b = b[rng.randrange(3) :] or b
        most, true = rng.randrange(20), distance(a, b)
        got = line_dedup._distance(np.array(a), np.array(b), most)
        assert (got == true) if true <= most else (got > most)


def test_lines_against_brute_force(spark):
    """Lines with words changed, a chain of changes and a hot line: all pairs of edit similarity 0.8 with up to two words changed."""
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "pon") for b in ("ra", "sun", "vel", "do", "nix")]
    lines = [" ".join(rng.choices(vocab, k=rng.randrange(8, 20))) for _ in range(25)]
    chain = lines[0].split()
    for k in range(6):  # each differs from the one before in one word
        chain = list(chain)
        chain[k] = f"new{k}"
        lines.append(" ".join(chain))
    for line in lines[1:12]:
        own = line.split()
        own[rng.randrange(len(own))] = "zzz"
        lines.append(" ".join(own))
    lines += [lines[2]] * 40
    docs = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(-(-len(lines) // 3))]
    flat = [(d, n, line) for d, t in docs for n, line in enumerate(t.split("\n"))]
    parent = list(range(len(flat)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(flat)):
        for j in range(i):
            a, b = flat[i][2], flat[j][2]
            if a == b or sum(x != y for x, y in zip(a.split(), b.split(), strict=False)) <= 2 and len(a.split()) == len(b.split()) and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {d: sum(1 for k, (e, _, _) in enumerate(flat) if e == d and find(k) != k) for d, _ in docs}
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_token_measures():
    """Against the vocabulary itself: shares are of tokens, line breaks are no fallback."""
    pieces, single = fertility.load_vocabulary()
    for text in ("plain words\nand lines\n", "漢字仮名 \U0001f9ff\U0001f9ff", "", "a"):
        ids = pieces.encode(text)
        n, per, share, entropy, _ = fertility.token_measures(text, pieces, single)
        names = [pieces.id_to_piece(i) for i in ids]
        raw = [x for x in names if x.startswith("<0x") and x not in ("<0x0A>", "<0x09>", "<0x0D>")]
        assert n == len(ids) and share == pytest.approx(len(raw) / max(1, len(ids)))
        assert per == pytest.approx(len(text) / len(ids) if ids else 0)
    assert fertility.token_measures("漢字仮名 \U0001f9ff\U0001f9ff", pieces, single)[2] > 0.2


def test_wide_leaf_and_clusters(spark):
    """Small leaves and blocks bring branching, pivots, wide nodes and clusters in parts into play; results stay exact."""
    from tests.llm.test_corpus_operators import near_brute

    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = {}
    for i in range(90):  # a family around one text, some of it linked in chains only, and documents with a common passage
        own = list(base)
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(60)] = f"c{rng.randrange(500)}"
        rows[i] = " ".join(own) if i % 3 else " ".join(base[:35] + [f"d{i}_{k}" for k in range(30)])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for how in ({"leaf": 4, "block": 6}, {"leaf": 16, "block": 512}, {"leaf": 4, "block": 40}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, **how).collect()}
        assert got == near_brute(rows), how


def test_leaf_of_labels():
    """Pairs of one label are none; all others of a node are found, and every member in one is named."""
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 256, 128).astype(np.uint8)
    low = np.array([np.where(rng.random(128) < 0.2, rng.integers(0, 256, 128), centre) for _ in range(12)]).astype(np.uint8)
    labels = np.array([1, 1, 1, 1, 1, 5, 6, 7, 8, 8, 9, 10])
    pairs, met = near_duplicates.compare_leaf(np.arange(12), low, labels)
    assert met.all() and len(pairs) == 11 and all(labels[a] != labels[b] for a, b in pairs)
