"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names; results against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventflow.llm import decontaminate, html, katz, line_dedup, mixing, phrases, pii, quality, simhash, tokens

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LINE = "This line is common to very many documents, word for word."
PASSAGE = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row int, `__key` int, tile long"


def words(text):
    return (text or "").encode().split()


def fixture_rows():
    texts = [
        None, "", " \n\t ", "one", "a b", "A B c\x1cd  e", f"{LINE}\nunique first", f"  {LINE.upper()} \nunique second\n{LINE}", f"third\n{LINE}", f"{LINE}\nfourth", f"fifth {LINE}\n{LINE}", f"{LINE}",
        f"before {PASSAGE} after one", f"other {PASSAGE} after two", f"{PASSAGE}", "la " * 90, "la " * 40 + "x", "mail a.b@c.example.org or call +1 (269) 555-3296 from 10.0.0.1 card 4111 1111 1111 1111 end",
        "password=b7db7aa4a5fcc78305 and token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" here", "<|endoftext|> special  spaces\r\n\r\n and '’s don't 日本語 ٣٤ ½", "HEY!! STOP!! NOW!! " * 8, "#### $$$$ %%%% **** " * 20,
        "the quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank to-day",
        " ".join(f"v{i % 977}x{i % 13}" for i in range(60_000)),
    ]
    rows = [(i, t, "en" if i % 2 else None, [None, "", "a", "B", "ß"][i % 5], None if i % 3 else 7, "x", i, i, i) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids and repeated rows on top."""
    return spark.createDataFrame([*rows, *rows[6:14], (None, rows[6][1], None, "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")


OPERATORS = {
    "katz": katz.katz_scores,
    "phrases": phrases.repeated_phrases,
    "quality": quality.quality_features,
    "quality_filter": quality.quality_filter,
    "line_report": line_dedup.line_dedup_report,
    "line_dedup": line_dedup.line_dedup,
    "simhash": simhash.simhash_report,
    "near_dedup": simhash.drop_near_duplicates,
    "mixing": mixing.mix_sources,
    "mixed": mixing.mixed_corpus,
    "pii": pii.personal_data,
}
PER_ROW = {"katz", "phrases", "quality", "line_report", "line_dedup", "simhash", "mixing", "pii"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(odd, none, name):
    assert OPERATORS[name](none).count() == 0
    got = OPERATORS[name](odd)
    n = len(got.collect())
    assert n == odd.count() if name in PER_ROW else n > 0


def test_empty_and_odd_for_the_rest(odd, none, bench, spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.token_counts(none, path).count() == 0
    assert tokens.token_counts(odd, path).count() == odd.count()
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(odd, bench).count() < odd.count()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_main_text(pages).count() == 0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_tokens_against_the_library(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(tokens.token_counts(docs, path))
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


def test_phrases_against_brute_force(docs, rows, width=35):
    seen = Counter()
    split = {i: words(t) for i, t, *_ in rows}
    for w in split.values():
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    got = by_id(phrases.repeated_phrases(docs))
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert got[12].n_removed == 61 and got[15].n_removed == 90  # the passage and the word after it, which both documents have


def test_quality_against_brute_force(docs, rows):
    got = by_id(quality.quality_features(docs))
    for i, t, *_ in rows:
        w = words(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = set()
        for k in range(len(w) - 4):
            if grams[tuple(w[k : k + 5])] > 1:
                inside.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert not got[20].kept and not got[21].kept and got[22].kept
    assert got[25].base_failed  # 60,000 words, but all of them in windows that come again


def test_cascade_order_does_not_change_verdicts(docs):
    one = {r.doc_id: r.kept for r in quality.quality_features(docs).collect()}
    two = {r.doc_id: r.kept for r in quality.quality_features(docs, tuple(reversed(quality.RULES)), sample_rows=1).collect()}
    assert one == two
    assert sorted(r.doc_id for r in quality.quality_filter(docs).collect()) == sorted(i for i, k in one.items() if k)


def test_lines_against_brute_force(docs, rows):
    def key(line):
        return line.encode().strip(b" \t\n\x0b\x0c\r").translate(LOWER).decode()

    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    keeper = {k: max(d) for k, d in holders.items() if len(k) >= 40 and len(d) >= 5}
    assert keeper
    got, whole = by_id(line_dedup.line_dedup_report(docs)), by_id(line_dedup.line_dedup(docs))
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        text = "\n".join(kept)
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest())
        assert whole[i].text == (None if t is None else text)


def test_hot_line_over_many_partitions(spark):
    """A line that all documents hold, over more range partitions than keys."""
    rows = [(i, f"{LINE}\nown line {i}\n{LINE}") for i in range(300)] + [(7, LINE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = line_dedup.line_dedup_report(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.n_dropped for r in got) == [0] + [1] + [2] * 299
    assert next(r for r in got if r.n_dropped == 0).doc_id == 299


def test_simhash_against_brute_force(docs, rows):
    import xxhash

    def fingerprint(t):
        w = (t or "").encode().translate(LOWER).split()
        if not w:
            return 0
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    small = [(i, t) for i, t, *_ in rows if not t or len(t) < 5000]
    fp = {i: fingerprint(t) for i, t in small}
    got = by_id(simhash.simhash_report(docs))
    for i in fp:
        assert got[i].fingerprint == f"{fp[i]:016x}"
    label = {i: i for i in got}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    changed = True
    while changed:
        changed = False
        for i in prints:
            low = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2)
            if low < label[i]:
                label[i], changed = low, True
    assert {i: r.component_id for i, r in got.items()} == label


def test_near_duplicates_against_brute_force(docs, rows):
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t, *_ in rows}

    def alike(a, b):
        return (not a and not b) or len(a & b) >= 0.8 * len(a | b)

    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min(label[j] for j in sets if alike(sets[i], sets[j])) for i in sets}
    for rows_per_part in (100_000, 40):
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, part_rows=rows_per_part).collect()) == sorted(set(label.values()))


def test_near_copies_are_found(spark):
    """Copies of longer texts with a few words changed; a large group among them."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 400)) for _ in range(60)]
    texts = []
    for k, words in enumerate(base):
        for copy in range(150 if k == 0 else 4):
            w = list(words)
            for at in rng.sample(range(len(w)), max(1, len(w) // 60) if copy else 0):
                w[at] = rng.choice(vocabulary)
            texts.append((k, " ".join(w)))
    sets = [simhash.shingle_set(t, 5) for _, t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, part_rows=400).collect()}
    heads = {}
    for i, (k, _) in enumerate(texts):
        heads.setdefault(k, i)
    assert set(heads.values()) <= kept
    near = [i for i, (k, _) in enumerate(texts) if i not in heads.values() and simhash.similarity(sets[i], sets[heads[k]]) >= 0.8]
    assert len(near) > 200 and len([i for i in near if i in kept]) <= 0.02 * len(near)


def test_near_copies_without_repeats_are_found(spark):
    """A text that repeats one phrase, and its copy that has it once: their shingle sets are all but equal."""
    import random

    rng, rows = random.Random(8), []
    for k in range(30):
        body, phrase = [f"d{k}w{rng.randrange(10**6)}" for _ in range(1000)], [f"p{k}x{i}" for i in range(5)]
        rows += [(2 * k, " ".join(body + phrase)), (2 * k + 1, " ".join(body + phrase * 46))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == set(range(0, 60, 2))


def test_pairs_of_a_large_templated_tile_are_found(spark):
    """Pairs on one template: the closest fingerprint in a tile is often that of an unlike text."""
    import random

    import pyarrow as pa

    rng = random.Random(4)
    template, rows = [f"t{i}" for i in range(200)], []
    for k in range(300):
        own = list(template)
        for p in rng.sample(range(200), 8):
            own[p] = f"o{k}x{p}"
        other = list(own)
        for p in rng.sample(range(200), 4):
            other[p] = f"e{k}x{p}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    bands = simhash.band_keys(pa.array([t for _, t in rows]), 5, 1, 2)
    brute = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (bands[i] == bands[j]).any() and simhash.similarity(sets[i], sets[j]) >= 0.8}
    label = list(range(len(rows)))
    for i, j in sorted(brute):
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    for parts in (1, 40):  # one part a tile, and tiles cut by range borders
        kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows=1, bands=2, part_rows=1200 // parts).collect()}
        assert kept == set(label)


def test_spanning_forest():
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    keep = simhash.spanning(a, b, w)
    parent, total, n = list(range(40)), 0, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in np.argsort(w, kind="stable").tolist():
        if (p := root(a[i])) != (q := root(b[i])):
            parent[p] = q
            total, n = total + w[i], n + 1
    assert len(keep) == n and w[keep].sum() == total


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(4):
            s ^= 1 << int(rng.integers(0, 64))
            s ^= 1 << int(rng.integers(0, 64))
            fps.add(s)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(spark.createDataFrame(signed, "fp long"), tile_rows=1)).collect()}
    values = [x[0] for x in signed]
    parent = {x: x for x in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for a in values:
        for b in values:
            if ((a & mask) ^ (b & mask)).bit_count() <= 2 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for x in values:
        least[root(x)].append(x)
    want = {x: min(group) for group in least.values() for x in group if len(group) > 1}
    assert roots == want


def test_mixing(docs, rows):
    got = [r for r in mixing.mix_sources(docs, ["doc_id", "source"]).collect()]
    size = {i: len(words(t)) for i, t, *_ in rows}
    by_source = defaultdict(list)
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        by_source[r.source].append(r)
    order = [*sorted((s for s in by_source if s is not None), key=lambda s: [ord(c) for c in s]), *([None] if None in by_source else [])]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(r["size"] for r in by_source[s]) for s in order}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * total[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 2 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in order:
        assert by_source[s][0].target == pytest.approx(target[s]) and by_source[s][0].source_size == total[s]
        assert abs(sum(r.taken for r in by_source[s]) - target[s]) <= 1
    again = sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(5)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    copies = mixing.mixed_corpus(docs).collect()
    assert sum(r.words_taken for r in copies) == sum(r.taken for r in got)


def test_mixing_is_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_katz_against_brute_force(docs, rows, k=5):
    split = {i: [b"<s>", *(t or "").encode().translate(LOWER).split(), b"</s>"] for i, t, *_ in rows}
    one, two, history = Counter(), Counter(), Counter()
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            history.update(w[:-1])
    total, distinct = sum(one.values()), len(one)

    def discounted(counts):
        n = Counter(counts.values())
        cut = (k + 1) * n[k + 1] / n[1] if n[1] else 0
        d = {}
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0
            d[r] = x if 0 < x < 1 else r / (r + 1)
        return lambda c: c * d.get(c, 1.0)

    du, db = discounted(one), discounted(two)
    singles = sum(v == 1 for v in one.values())
    unknown = singles / total
    scale = (1 - unknown) / sum(du(v) for v in one.values())

    def unigram(w):
        return du(one[w]) * scale if one[w] else unknown

    mass, base = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        mass[h] += db(c)
        base[h] += unigram(w)

    def p(h, w):
        if not history[h]:
            return unigram(w)
        left, by = history[h] - mass[h], history[h]
        if left <= 1e-9 * by:
            left, by = 1, by + 1
        return db(two[h, w]) / by if two[h, w] else left / by / (1 - base[h]) * unigram(w)

    got = by_id(katz.katz_scores(docs, block_bytes=20_000, shard_bytes=50_000))
    for i, w in split.items():
        r = got[i]
        assert r.n_tokens == len(w) - 1 and r.n_known == sum(one[x] > 0 for x in w[1:]) and r.train_tokens == total
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w[1:]))
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(w, w[1:])))
    vocabulary = [*one, b"never seen"]
    for h in (b"<s>", b"the", b"la", b"word3"):
        assert sum(p(h, w) for w in vocabulary) == pytest.approx(1)


def test_leaks(docs, bench):
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(12, 1), (13, 1), (14, 1)}
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {12, 13, 14}


def test_leaks_of_every_length_are_found(spark):
    """Items with three words in ten replaced, whatever their length: what settling every passage with every item finds."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    items = [[rng.choice(pool) for _ in range(n)] for n in [*range(15, 23)] * 3 + [*range(50, 57)] * 6]
    bench = decontaminate.Benchmark.of([(i, " ".join(x)) for i, x in enumerate(items)])
    texts = []
    for x in items:
        leak = list(x)
        for k in rng.sample(range(len(x) - 5), int(len(x) * 0.3)):
            leak[k] = f"other{rng.randrange(9999)}"
        around = [f"around{rng.randrange(9999)}" for _ in range(200)]
        cut = rng.randrange(60, 140)
        texts.append(" ".join([*around[:cut], *leak, *around[cut:]]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    p = decontaminate.Passages(pa.array(texts), bench)
    n = len(bench.vocabulary)
    m = decontaminate.Matcher(bench, np.eye(n), np.ones(n), 1.0, 0.5, 0.7, 5, 8, 8)
    brute = {(int(p.doc_of_half[h]), i) for h in range(p.n_halves) for i in range(len(items)) if m._share(p, h, i)}
    assert got == brute
    assert got >= {(i, i) for i in range(len(items))}


def test_lcs():
    assert decontaminate.lcs([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontaminate.lcs([1], []) == 0


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_personal_data(docs, rows):
    got = by_id(pii.personal_data(docs))
    for i, t, *_ in rows:
        base = slow_base(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in pii.KINDS]
        spelled = pii.spelled(base)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(r.spans.split(","))
    secrets = rows[18][1]
    assert {secrets[int(s) : int(e)] for k, s, e in (x.split(":") for x in got[18].spans.split(",")) if k == "secret"} == {"b7db7aa4a5fcc78305", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"}


def test_base_spans_on_random_strings():
    import random

    rng = random.Random(2)
    parts = [*"ab1290@.+-() ", "a@b.c", "1.2.3.4", "4111111111111111", "+1 269", "555-3296", "@@", ".."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == slow_base(text)


PAGES = [
    (1, "u1", "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy this thing now</div><article><h1>Head &amp; line</h1><p>First  paragraph\n of <a href=x>linked</a> words.<p>Second one here.<section class=comments><p>Nice text, friend</p></section></article><footer>&copy; foot</footer>"),
    (2, "u2", None), (3, "u3", ""), (4, None, "<script>never closed"), (5, "u5", "<!-- only a comment"),
    (6, "u6", "<body><div id=header>Site name and more</div><div class=cookie-notice>We use cookies, please accept</div><div id=content><h2>A title</h2><p>Some words in a paragraph that are content.</p><div class=ad-slot>Cheap offers for you today</div><p>More words that are content as well.</p></div><aside>Related things</aside><form><input> Your mail</form></body>"),
    (7, "u7", "<p>1 < 2 and a &lt; b &#233;&nbsp;x</p>"),
]


def test_main_text(spark):
    got = {r.page_id: r for r in html.extract_main_text(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    assert len(got) == len(PAGES)
    assert got[1].text == "Head & line\nFirst paragraph of linked words.\nSecond one here."
    assert [got[i].text for i in (2, 3, 4, 5)] == [""] * 4
    assert got[6].text == "A title\nSome words in a paragraph that are content.\nMore words that are content as well."
    assert got[7].text == "1 < 2 and a < b é x"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_of_the_test_pages(spark, sf):
    """Against the article element that these pages happen to name."""
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1).replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
