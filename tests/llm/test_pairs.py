"""N-gram join, decontamination and pipeline against brute force, on small fixtures and the smallest tables."""

from __future__ import annotations

import math
import random
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from codeloom.llm import decontaminate, ngram_join, quality, sql

SF = "/root/testdata/sf0.001"
#: Extra columns with the names that the operators use themselves.
EXTRA = ["key", "print", "labels", "crowded", "start", "size", "shingle", "loom_key", "text_", "class_id"]


def made(spark, rows):
    return spark.createDataFrame([(i, t, *("x" for _ in EXTRA)) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in EXTRA))


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    n, group = [0] * len(sets), list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 5 * len(x & y) >= 4 * len(x | y):
                n[a] += 1
                n[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((sets[k][0] for k in range(len(sets)) if group[k] == g and sets[k][0] is not None), default=None) for g in group}
    return sorted((str(sets[k][0]), str(least[group[k]]), n[k]) for k in range(len(sets)))


def near_copies(seed, groups, size, words=60):
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(25)]
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        if g % 2:
            base[10:35] = passage
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("node", [ngram_join.NODE, 2])
def test_join_equals_brute_force(spark, monkeypatch, node):
    monkeypatch.setattr(ngram_join, "NODE", node)  # 2: nearly all texts go the way of crowded nodes
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "LARGE", 16)
    rows = near_copies(5, 6, 18) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "one"), (None, "w1 w2 w3 w4 w5 w6"), (905, "one"), (906, "z " * 9000)]
    got = ngram_join.jaccard_classes(made(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == brute_links(rows)


def test_join_of_nothing(spark):
    assert ngram_join.jaccard_classes(made(spark, [])).count() == 0


def test_keep_one(spark):
    rows = near_copies(2, 3, 6) + [(500, None), (501, ""), (None, "lone text of six words here"), (None, "lone text of six words here"), (500, None)]
    kept = ngram_join.keep_one(made(spark, rows))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    brute = {c for _, c, _ in brute_links(rows)}
    assert {str(r["doc_id"]) for r in kept.collect()} == brute and kept.count() == len(brute)


def test_floor_reaches_the_target_and_no_longer_prefix_does():
    floor = ngram_join.floor_depth()
    assert ngram_join.met(0.8, floor) >= ngram_join.TARGET > ngram_join.met(0.8, floor + 1)


def test_texts_with_partners_stop_at_longer_prefixes(spark):
    star = [(b"a", bytes([k]), 0.95) for k in range(1, 9)] + [(b"y", b"z", 0.82)]
    edges = spark.createDataFrame(star, "src binary, dst binary, similarity double")
    done = {bytes(r["print"]) for r in ngram_join._finished(edges, 5).collect()}
    assert done == {b"a"}  # one partner does not reach the target, eight do
    assert {bytes(r["print"]) for r in ngram_join._finished(edges, ngram_join.floor_depth()).collect()} >= {b"a", b"y"}


def plain_walk(rows, floor):
    """Pairs by their longest shared prefix, and texts of crowded nodes, by comparing all."""
    shared = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    pairs, crowded = {}, set()
    for n, (p, a) in enumerate(rows):
        for q, b in rows[:n]:
            if (k := shared(a, b)) and p != q:
                pair = (min(p, q), max(p, q))
                pairs[pair] = max(pairs.get(pair, 0), floor + k - 1)
    nodes = {}
    for p, a in rows:
        nodes.setdefault(a[0], []).append(p)
    crowded = {p for ps in nodes.values() if len(ps) > ngram_join.NODE for p in ps}
    return pairs, crowded


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_walk_equals_comparing_all(batch):
    import pyarrow as pa

    rng = random.Random(batch)
    levels = len(ngram_join._PREFIXES)
    rows = [(f"t{k}".encode(), tuple(rng.randrange(4) if n else rng.randrange(30) for n in range(levels))) for k in range(150)]
    rows += [(f"h{k}".encode(), (5, 1, rng.randrange(20), 7, 7, 7)[:levels]) for k in range(60)]
    rows.sort(key=lambda r: r[1])
    batches = []
    for at in range(0, len(rows), batch):
        part = rows[at : at + batch]
        batches.append(pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.binary()), *(pa.array([a[n] for _, a in part], pa.int64()) for n in range(levels))], ["print", *ngram_join._PREFIXES]))
    pairs, crowded = {}, set()
    for out in ngram_join._walk(iter(batches)):
        for a, b, d in zip(*(c.to_pylist() for c in out.columns), strict=True):
            if b is None:
                crowded.add(a)
            else:
                pairs[a, b] = max(pairs.get((a, b), 0), d)
    want, full = plain_walk(rows, ngram_join.floor_depth())
    free = lambda found: {k: d for k, d in found.items() if k[0] not in full or k[1] not in full}
    assert crowded == full and free(pairs) == free(want)


def test_components_with_hubs(spark, monkeypatch):
    from codeloom.llm import common

    monkeypatch.setattr(common, "HUB", 1 / 10)
    edges = [(0, k) for k in range(1, 400)] + [(500, k) for k in range(501, 505)] + [(k, k + 1) for k in range(600, 640)] + [(399, 600)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[k] == 0 for k in [*range(400), *range(600, 641)]) and all(got[k] == 500 for k in range(500, 505))


def brute_contaminated(docs, items):
    out = set()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = lambda gs: {g: gs.count(g) for g in gs}
    for d, text in docs:
        w = (text or "").split()
        for i, item in items:
            v = (item or "").split()
            if len(v) < 5:
                continue
            want = count(grams(v))
            for start in range(-len(v) + 5, len(w)):
                have = count(grams(w[max(start, 0) : min(start + len(v), len(w))]))
                shared = sum(min(n, want.get(g, 0)) for g, n in have.items())
                if 5 * shared >= 4 * (sum(have.values()) + sum(want.values()) - shared) and shared:
                    out.add((d, i))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 50)))) for k in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for k in range(60):
        text = [word() for _ in range(rng.randrange(0, 120))]
        if k % 2:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = word()
            cut = rng.choice([0, 0, 1, 3])
            at = rng.choice([0, len(text) // 2, len(text)])
            text[at:at] = part[cut:]
        docs.append((k, " ".join(text)))
    docs += [(90, None), (91, ""), (1, docs[1][1]), (92, " ".join(f"u{k}" for k in range(3000)) + " " + items[3][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(made(spark, docs), table).collect()}
    assert got == brute_contaminated(docs, items) and got
    clean = decontaminate.keep_clean(made(spark, docs), table)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in got})
    assert decontaminate.contaminated(made(spark, []), table).count() == 0
    assert decontaminate.contaminated(made(spark, docs), table.limit(0)).count() == 0


def test_index_meets_all_within_the_radius(spark):
    rng = random.Random(3)
    bits = [rng.getrandbits(64) for _ in range(40)]
    flipped = []
    for k, x in enumerate(bits):
        for place in rng.sample(range(64), decontaminate.RADIUS if k % 2 else rng.randrange(decontaminate.RADIUS)):
            x ^= 1 << place
        flipped.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = decontaminate._in_blocks(spark.createDataFrame([(k, signed(x)) for k, x in enumerate(bits)], "item int, print bigint"), decontaminate.FLIPS)
    right = decontaminate._in_blocks(spark.createDataFrame([(k, signed(x)) for k, x in enumerate(flipped)], "window int, print bigint"))
    met = {(r["item"], r["window"]) for r in left.drop("print").join(right, ["block", "bits"]).select("item", "window").distinct().collect()}
    assert {(k, k) for k in range(40)} <= met


def test_ids_do_not_join_documents_or_items(spark):
    part = [f"p{k}" for k in range(40)]
    item, half, other = " ".join(part), " ".join(part[:22]), " ".join(part[18:])
    # halves of the item in different documents of one id and size: none holds it
    table = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    halves = [(None, half + " " + " ".join(f"x{k}" for k in range(18))), (None, " ".join(f"y{k}" for k in range(18)) + " " + other)]
    clean = [(None, "clean text of no item at all"), (7, "another clean text of no item")]
    docs = made(spark, [*halves, *clean, (None, item), (7, "so " + item)])
    assert decontaminate.contaminated(made(spark, halves), table).count() == 0
    assert sorted(r["text"] for r in decontaminate.keep_clean(docs, table).collect()) == sorted(t for _, t in halves + clean)
    # two texts of one item_id, each half in the document
    two = spark.createDataFrame([(1, half + " " + " ".join(f"x{k}" for k in range(18))), (1, " ".join(f"y{k}" for k in range(18)) + " " + other)], "item_id bigint, text string")
    assert decontaminate.contaminated(made(spark, [(3, item)]), two).count() == 0


def test_similar_pairs_beyond_the_radius_are_found(spark):
    # one heavy shingle of the item is another heavy shingle in the documents: similar, but with other fingerprints
    items, docs = [], []
    for k in range(12):
        rest = [f"i{k}w{n}" for n in range(100)]
        items.append((k, " ".join([f"a{k}"] * 12 + rest)))
        items.append((100 + k, " ".join([f"b{k}"] * 12)))
        docs.append((k, " ".join([f"b{k}"] * 12 + rest)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(made(spark, docs), table).collect()}
    assert got == {(k, k) for k in range(12)} | {(k, 100 + k) for k in range(12)}


def quality_rows(con, docs):
    con.register("documents", docs)
    return con.execute(sql.OP6).df()


def test_quality_equals_sql_and_takes_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["ab", "cd#", "é" * 3, "x"]) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 60))), f"h{k % 3}") for k in range(60)]
    rows += [(100 + k, "a b c d e " * 9 + "\nq\nq", "bad") for k in range(30)] + [(200, None, "h1"), (201, "", None), (202, " \t", None), (205, " ".join(f"w{k}" for k in range(50_000)), "h2"), (203, "it $$$$$$$$$$$$ is one good line of text with more words", "bad"), (204, "it is one good line of text with more clean words", "bad"), (1, rows[1][1], "h1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_words int")
    got = quality.quality_report(docs).toPandas()
    want = quality_rows(duckdb.connect(), pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 204 in ids and 203 not in ids and 200 not in ids
    assert quality.quality_report(docs.limit(0)).count() == 0


def plain_kept(rows):
    """The quality rules by plain Python: ids of kept rows. rows: doc_id, text, source."""
    ruled = []
    for i, text, source in rows:
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", text or "") if x]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
        n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
        base = n < 10 or 100 * len(inside) > 20 * n
        soft = 100 * symbols > 25 * n or chars < 2 * n or chars > 20 * n or len(lines) - len(set(lines)) > n / 10
        ruled.append((i, source, base, soft))
    hosts = {}
    for _, source, base, soft in ruled:
        n, k = hosts.get(source, (0, 0))
        hosts[source] = (n + 1, k + (base or soft))
    rates = [k / n for n, k in hosts.values()]
    mean = min(max(sum(rates) / len(rates), 0.001), 0.999)
    size = sum(n for n, _ in hosts.values()) / len(hosts)
    spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / (len(rates) - 1) if len(rates) > 1 else 0
    strength = min(max(mean * (1 - mean) / spread - 1, 1), size) if spread else size

    def condemned(source):
        n, k = hosts[source]
        a, b = mean * strength + k, (1 - mean) * strength + n - k
        return a / (a + b) - 2 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > 0.6

    return {i for i, source, base, soft in ruled if not base and not (soft and condemned(source))}


def plain_redacted(text):
    """Base patterns and quoted or bare literals behind sensitive names, by plain patterns."""
    spans = [m.span() for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", text)]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text)]
    out, at = "", 0
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if b > at:
            out += text[at : max(a, at)] + ("" if out.endswith("[SECRET]") and a <= at else "[SECRET]")
            at = b
    return out + text[at:]


def test_pipeline_equals_brute_force(spark):
    pytest.importorskip("corpus_pipeline")
    import sentencepiece as library

    import corpus_pipeline
    from codeloom.llm import queries

    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rows = con.execute("SELECT doc_id, text, source FROM documents").fetchall()
    good = plain_kept(rows)
    docs = [(i, t) for i, t, _ in rows if i in good]
    first = {int(c) for _, c, _ in brute_links(docs)}
    docs = [d for d in docs if d[0] in first]
    dirty = {d for d, _ in brute_contaminated(docs, con.execute("SELECT item_id, text FROM benchmark").fetchall())}
    coder = library.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = {d: coder.encode(plain_redacted(t)) for d, t in docs if d not in dirty}
    assert out == want


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = " ".join(f"word{k}" for k in range(40))
    item = " ".join(f"bench{k}" for k in range(30))
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (None, good), (None, good), (5, good), (6, "so " + item + " it is"), (None, item), (7, " ".join(f"long{k}" for k in range(60_000))), (8, 'here is password = "hunter2hunter2" ' + " ".join(f"q{k}" for k in range(20)))]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), "k", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, print int")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), out.schema)
    got = {(r["doc_id"], len(r["ids"]) > 10) for r in seen.collect()}
    assert got == {(5, True), (7, True), (8, True)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_fingerprints_find_the_pairs(spark, monkeypatch):
    """Windows with some words changed, down to the threshold: what is found is found by the index, and that is most of what brute force finds."""
    rng = random.Random(11)
    items = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(60))) for k in range(12)]
    docs = []
    for k, text in items:
        for changed in (0, 1, 1, 1):
            w = text.split()
            for at in rng.sample(range(60), changed):
                w[at] = "changed"
            docs.append((len(docs), " ".join([*(f"a{rng.randrange(900)}" for _ in range(30)), *w, *(f"b{rng.randrange(900)}" for _ in range(30))])))
    table = spark.createDataFrame(items, "item_id bigint, text string")

    def similar(doc, item):
        d, i = [[tuple(x.split()[j : j + 5]) for j in range(len(x.split()) - 4)] for x in (doc, item)]
        best = max(sum(g in set(i) for g in d[s : s + len(i)]) for s in range(len(d) - len(i) + 1))
        return 5 * best >= 4 * (2 * len(i) - best)

    true = {(a, b) for a, x in docs for b, y in items if similar(x, y)}
    found = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(made(spark, docs), table).collect()}
    got = found()
    assert got <= true and len(got) >= 0.9 * len(true) and len(true) >= 40
    blocks = decontaminate._in_blocks
    monkeypatch.setattr(decontaminate, "_in_blocks", lambda df, flips=0: blocks(df, flips).where("block < 0"))
    assert not found()
