"""The corpus operators against brute force on small tables with nulls, blanks, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, fertility, language, line_dedup, near_duplicates, pitman_yor, source_mix, substring_dedup, toxicity, warc
from inkwell.llm.common import connected_components, cut, likely_in, without

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 9 == 0 else f"Wo{i}" for i in range(80)]
    out = {}
    for i in range(n):
        if i in (7, 8):
            out[i] = None if i == 7 else ""
        elif i in (9, 10):
            out[i] = "one two" if i == 9 else " \n\t "
        elif i % 6 == 5:
            base = (out[i - 2] or "x y z").split(" ")
            base[rng.randrange(len(base))] = "changed"
            out[i] = " ".join(base)
        elif i % 6 == 4:
            out[i] = out[i - 1]
        else:
            out[i] = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 5)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 1, "clash") for i, t in texts().items()]
    return cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, spans string").repartition(3))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def near_brute(rows):
    sets = {}
    for d, t in rows.items():
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("how", [{}, {"leaf": 3, "block": 3}])
def test_near_duplicates(docs, how):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, **how).collect()}
    assert got == near_brute(texts())


def test_near_duplicates_edges(spark, docs, empty):
    assert near_duplicates.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert near_duplicates.drop_near_duplicates(docs).columns == docs.columns


def repeats_brute(rows, length):
    seen, out = set(), {}
    for d in sorted(rows):
        data = (rows[d] or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                mark[p : p + length] = b"\x01" * length
            seen.add(data[p : p + length])
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        out[d] = (len(data), len(data) - len(kept), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [2, 5000])
def test_substrings(spark, docs, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    rows = texts() | {100: "ab" * 300, 101: "x" + "ab" * 300, 102: "q" * 99, 103: "q" * 250}
    own = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(own).collect()}
    assert got == repeats_brute(rows, 100)


def test_substrings_empty(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_hash_comparison_sorts_suffixes():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8)) for _ in range(200)]
    data, size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    strings = substring_dedup.Strings(data, np.cumsum(size) - size, size)
    order = substring_dedup.merge_sort(np.zeros(200, np.int64), strings.take(np.arange(200), np.zeros(200, np.int64), size))
    assert order.tolist() == sorted(range(200), key=lambda i: (parts[i], i))


def test_lines(spark):
    line = "The quick brown fox jumps over the lazy dog near the old river bank while nine small birds sing in the tall green trees beside the long stone wall of the quiet village market square today"
    near = line.replace("Nine", "nine") + "!"
    rows = [(1, f"{line}\nshort one\nother words that stay here forever"), (2, f"short one\n{near}"), (3, line), (4, None), (5, ""), (5, ""), (None, line)]
    own = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lines string")
    got = sorted(((r.doc_id, r.text, r.removed, r.lines) for r in line_dedup.dedup_lines(own).collect()), key=str)
    want = [(1, rows[0][1], 0, "x"), (2, "short one", 1, "x"), (3, "", 1, "x"), (4, None, 0, "x"), (5, "", 0, "x"), (5, "", 0, "x"), (None, line, 0, "x")]
    assert got == sorted(want, key=str)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_edit_similarity_equals_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.choice("abcdeé ") for _ in range(rng.randrange(0, 90))]
        b = list(a)
        for _ in range(rng.randrange(0, 24)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.choice("abcdeé ")] * rng.randrange(2)
        a, b = "".join(a), "".join(b)
        assert line_dedup.edit_similarity(a, b) == (edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_lines_with_one_or_two_words_changed(spark):
    """Recall against brute-force edit similarity on lines of 8 to 60 words: every pair that differs in one or two words."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 11))) for _ in range(400)]
    rows, want = [], set()
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(8 + i * 52 // 119)]
        near = list(words)
        for k in rng.sample(range(len(words)), 1 + i % 2):
            near[k] = rng.choice(vocab)
        a, b = " ".join(words), " ".join(near)
        rows += [(i, a), (1000 + i, b)]
        if edits(a, b) <= 0.2 * max(len(a), len(b)):
            want.add(1000 + i)
    assert len(want) > 100
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("removed > 0").collect()}
    assert got == want


def test_line_blocks_find_all_near_signatures():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sims = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(j)) for k, j in ((3, 60), (20, 21), (0, 40))]]))
    found = set()
    for keys in line_dedup.block_keys(sims):
        a, b = line_dedup.near_signatures(keys, sims)
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    parent = {int(s): int(s) for s in sims}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a)] = find(b)
    assert all(find(int(x)) == find(int(y)) for x in sims for y in sims if bin(int(x) ^ int(y)).count("1") <= 3)


def test_lines_empty(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("block", [32_000_000, 60])
def test_contamination(spark, docs, block):
    own = texts()
    bench = [(1, " ".join(own[0].split()[:20])), (2, own[2]), (3, "one two"), (4, None), (5, "??"), (6, "not in any text at all " * 3), (7, own[2])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in bench:
        w = word.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = decontaminate.find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block)
    for r in out.collect():
        w, hit, items = word.findall(lower(own[r.doc_id])), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) == (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))


def test_contamination_empty(docs, empty):
    none = empty.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.find_contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, none).count() == 0


def test_quality(docs):
    for r in fertility.quality(docs).collect():
        t = texts()[r.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_bands(spark, empty):
    rows = [(1, "This is a perfectly ordinary sentence about the weather in the north of the country."), (2, "zq# xk% vj& qz* kx$ jv| zq< xk> vj# qz% kx& jv* zz$ qq|")]
    got = {r.doc_id: r.kept for r in fertility.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}
    assert fertility.quality(empty).count() == 0


def test_warc(spark):
    big = "<p>" + "é" * 80
    rows = [(5, "http://a/\r\nx", big), (2, "http://b", big), (9, None, None), (3, "u", "tiny"), (4, "u", "tiny"), (7, "u", "other " * 40), (7, "u", "other " * 40)]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), roll_bytes=500).collect())
    size = len(big.encode())
    assert got == [(2, size, "response", None, True), (3, 4, "response", None, True), (4, 4, "response", None, True), (5, size, "revisit", 2, True), (7, 240, "response", None, True), (7, 240, "response", None, True), (9, 0, "response", None, True)]
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_round_trip():
    records = [warc.format_record(i, f"http://x/{i}", b"body %d " % i * 50, hashlib.sha256(b"").hexdigest(), None if i % 3 else 0, "2024-01-01T00:00:00Z") for i in range(300)]
    data = warc.write_archive(records)
    assert list(warc.read_archive(data)) == records and len(data) < sum(map(len, records)) / 4
    assert data[:4] == b"\x5d\x2a\x4d\x18"


def test_language(spark, docs, empty):
    words = {"aa": ["nga", "mbo", "kuwa", "tanda"], "bb": ["öst", "ärl", "skö", "fjä"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.language_of_documents(spark, own).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert language.language_of_documents(spark, empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit_languages(empty)).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        body = [rng.choice(plain) for _ in range(30)]
        if bad:
            body[rng.randrange(30)] = "scoundrel"
        if (bad and i % 8 == 0) or i % 40 == 1:
            body[rng.randrange(30)] = "women"
        rows.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    own, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(own, marked)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(own, model).collect()}
    assert sum(got[i] == y for i, y in labels) >= 396
    ask = spark.createDataFrame([(1, "women word1 word2"), (2, "men word1 word2"), (3, None), (4, "")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(ask, model).collect()}
    assert abs(score[1] - score[2]) < 0.1 and score[1] < 0.7 and 0 <= score[3] == score[4] < 0.7
    assert toxicity.drop_toxic(own, model).count() == 400 - sum(got.values())
    assert toxicity.fit_toxicity(docs, marked.where("false")).bias == -30.0 and toxicity.score_toxicity(empty, model).count() == 0


def test_mix(docs, empty):
    got = [r.asDict() for r in source_mix.mix_sources(docs).collect()]
    size = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(texts()[r["doc_id"]] or "")) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
    order, total = ["a", "b", None], sum(size.values())
    want = {s: total * (i + 1) / 6 for i, s in enumerate(order)}
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == size[r["source"]] for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] for s in order)
    assert source_mix.mix_sources(empty).count() == 0


def test_mix_caps(spark):
    totals = spark.createDataFrame([("0a", 900), ("0b", 10), ("0c", 0), ("0d", 90)], "skey string, source_size long")
    got = {r.skey: r.target for r in source_mix.source_targets(totals).collect()}
    assert got == pytest.approx({"0a": 700.0, "0b": 30.0, "0c": 0.0, "0d": 270.0})


def test_language_model(docs, empty):
    train = F.coalesce(~language.held_out("doc_id", 5, 1), F.lit(False))
    model = pitman_yor.fit(docs.where(train))
    got = {r.doc_id: r for r in pitman_yor.score(docs.withColumn("train", train), model).collect()}
    own = {d: [*WORD.findall(lower(t)), None] for d, t in texts().items()}
    counts = Counter(w for d, ws in own.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert model.vocabulary == v
    for d, ws in own.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(got[d].base_score, base, rel_tol=1e-9, abs_tol=1e-9) and got[d].score < 0
    assert pitman_yor.score(empty.withColumn("train", F.lit(True)), model).count() == 0
    assert pitman_yor.perplexity(pitman_yor.score(docs.withColumn("train", train), model)).first().perplexity > 1


def test_model_probabilities_sum_to_one(spark):
    """Over all words and one unknown one, after a word of the text: scores of texts of one word, less those of their ends."""
    rng = random.Random(4)
    train = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(30)], "doc_id long, text string")
    model = pitman_yor.fit(train, most=3)
    p = 10.0 ** model.log_p()[0].astype(float)
    words = [w for w in "abcdefgh"]
    ask = spark.createDataFrame(list(enumerate([*words, "zzz"])), "doc_id long, text string").withColumn("train", F.lit(False))
    full = {r.doc_id: r.score for r in pitman_yor.score(train.withColumn("train", F.lit(True)).select("doc_id", "text", "train").unionByName(ask.withColumn("doc_id", F.col("doc_id") + 100)), model).where("doc_id >= 100").collect()}
    frequent = {int(h) for h in model.frequent}
    from inkwell.llm.common import text_blocks, word_hashes, word_spans

    total = float(p[0])
    for i, w in enumerate([*words, "zzz"]):
        _, _, data, offs = next(text_blocks(pa.array([w])))
        h = int(word_hashes(data, *word_spans(data, offs)[:2])[0])
        context = sorted(frequent).index(h) + 1 if h in frequent else len(frequent) + 1
        total += 10.0 ** (full[100 + i] - float(model.log_p()[context][0]))
    assert total == pytest.approx(1.0, abs=1e-5)


def test_scores_do_not_depend_on_partitions(spark, docs):
    """The same seating, and so the same scores, whatever the number of shuffle partitions; repeated documents score higher."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"r{rng.randrange(3000)}" if rng.random() < 0.5 else f"c{rng.randrange(5)}" for _ in range(30))) for i in range(80)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True))
    found = []
    for parts in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({r.doc_id: r.score / r.n_tokens for r in pitman_yor.score(own, pitman_yor.fit(own, most=20)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(math.isclose(found[0][d], found[1][d], rel_tol=1e-9) for d in found[0])
    twice, once = [found[0][i] for i in range(20)], [found[0][i] for i in range(20, 80)]
    assert np.mean([a > b for a in twice for b in once]) > 0.95


def test_tables_of_one_customer_and_many():
    rng = np.random.default_rng(0)
    c = np.array([1, 2, 64, 65, 5000])
    t = pitman_yor.seat(c, np.full(5, 1e-3), np.full(5, 10.0), 0.75, rng)
    assert t[0] == 1 and (t >= 1).all() and (t <= c).all()


def test_components_and_filters(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 90)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == 90
    ids, rows = spark.range(0, 1000, 7), spark.range(3000)
    kept = {r.id for r in rows.where(likely_in(ids, F.col("id"))).collect()}
    assert kept >= set(range(0, 1000, 7)) and len(kept) < 160
    assert {r.id for r in without(rows, ids, "id").collect()} == set(range(3000)) - set(range(0, 1000, 7))


def line_key(line):
    """What two lines share where one is removed as the other's exact repeat: their words, digits alike; none for short lines."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[0-9]", "0", lower(line)))
    return tuple(words) if len(words) >= 5 else None


def contaminated_brute(rows, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in bench:
        w = word.findall(lower(t))
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    out = set()
    for d, t in rows.items():
        w, hit = word.findall(lower(t)), set()
        for n in {len(k) for k in windows}:
            hit |= {i for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for i in range(k, k + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def test_pipeline(spark, tmp_path):
    """Every stage against brute force (the first, a model, against its own scores) on what the stage before it kept of the small tables."""
    import corpus_pipeline
    import duckdb
    from inkwell.llm import queries

    from ..conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut(stage(spark, docs, SF))
        before, after = ({r.doc_id: r.text for r in df.collect()} for df in (docs, out))
        assert out.columns[: len(columns)] == columns and set(after) <= set(before)
        if k == 0:
            model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.score < 0.7}
        if k == 1:
            assert set(after) == set(before)
            seen = set()
            for d in sorted(before):
                left = iter((after[d] or "").split("\n"))
                here = next(left, None)
                for line in (before[d] or "").split("\n"):
                    kept = here == line
                    here = next(left, None) if kept else here
                    key = line_key(line)
                    assert not (kept and key in seen) and (kept or key is not None)
                    seen |= {key} if key else set()
                assert here is None or not after[d]
        if k == 2:
            assert set(after) == {d for d, (_, c) in near_brute(before).items() if c == d}
        if k == 3:
            assert set(before) - set(after) == contaminated_brute(before, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
        if k == 4:
            docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
            taken = {d: n for d, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLE_SQL['op6_source_mix']})").fetchall() if n}
            copies = Counter(r.doc_id for r in out.collect())
            sizes = {d: len(WORD.findall(t or "")) for d, t in before.items()}
            assert {d: copies[d] * sizes[d] for d in copies if sizes[d]} == taken
        docs = out
    assert docs.count() == docs.select("doc_id", "copy").distinct().count()
