"""Jaccard join, substring removal, packing and token counts against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from costlens.llm import components, jaccard, packing, substrings, tokenfiles
from costlens.llm.tokens import Encoder
from costlens.session import scratch_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(rng, n=300):
    return ["".join(rng.choices("abcdeéß日", k=rng.randint(1, 6))) for _ in range(n)]


def corpus(seed=0, n=60, length=(0, 160)):
    """Texts with copies, near copies, a shared passage, and awkward cases."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    text = lambda k: " ".join(rng.choices(words, k=k))
    base, passage = text(140).split(), text(60)
    rows = [(i, text(rng.randint(*length))) for i in range(n)]
    for i in range(n, n + 25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((i, " ".join(near)))
    rows += [(n + 30 + i, f"{text(20)}\n{passage}\t{text(20)}") for i in range(8)]
    rows += [(n + 40 + i, rows[3][1]) for i in range(4)]
    rows += [
        (n + 50, None), (n + 51, ""), (n + 52, " \n\t"), (n + 53, "one two"), (n + 54, "One  TWO"), (n + 55, "É one"), (n + 56, "é one"),
        (n + 57, "a" * 700), (n + 58, "a" * 350 + "b" + "a" * 340), (n + 59, "ab" * 200), (n + 60, "x" * 99), (n + 61, "x" * 99),
        (n + 62, " ".join(words * 40)), (n + 53, "one two"), (-5, rows[5][1]), (None, "one two"), (None, None),
    ]
    return rows


def shingles(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_join(make_docs):
    rows = corpus(1)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len(want) - 10
    assert sorted(tuple(r) for r in jaccard.join(make_docs(rows)).collect()) == want


def test_jaccard_join_splits_large_groups(make_docs):
    rows = corpus(2)
    assert sorted(tuple(r) for r in jaccard.join(make_docs(rows), block=3).collect()) == brute_components(rows)


def test_jaccard_join_of_nothing(make_docs):
    assert jaccard.join(make_docs([])).count() == 0
    assert [tuple(r) for r in jaccard.join(make_docs([(4, None)])).collect()] == [(4, 0, 4)]


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}, sets


def test_all_links_are_counted(make_docs):
    rows = corpus(2)
    want, sets = brute_links(rows)
    count = Counter(x for pair in want for x in pair)
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values() if s}
    counts = sorted((i, len(sets[i]), first.get(sets[i], i), count[i]) for i, _ in rows if i is not None)
    different = sorted((a, b) for a, b in want if sets[a] != sets[b] and first[sets[a]] == a and first[sets[b]] == b)
    assert len(different) > len({x for pair in different for x in pair})  # more than a forest
    for block in (jaccard.BLOCK, 3):
        assert sorted(tuple(r) for r in jaccard.link_counts(make_docs(rows), block=block).collect()) == counts
        assert sorted(tuple(r) for r in jaccard.pairs(make_docs(rows), block=block).collect()) == different
    assert jaccard.link_counts(make_docs([])).count() == 0


def test_divide_skip_finds_all_partners():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(150)]
    lists = jaccard.Lists(sets)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if j != i and 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(lists.partners(i).tolist()) == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)]
    random.Random(4).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def brute_substrings(rows, length=100):
    seen, out = set(), []
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    done = {}
    for i in sorted(texts):
        raw = texts[i]
        mark = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                mark[a : a + length] = b"\1" * length
            seen.add(raw[a : a + length])
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        runs = sum(1 for a in range(len(raw)) if mark[a] and (a == 0 or not mark[a - 1]))
        done[i] = (i, len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    for i, _ in rows:
        if i is not None:
            out.append(done[i])
    return sorted(out)


def test_substrings(make_docs):
    rows = corpus(5)
    want = brute_substrings(rows)
    assert sum(r[2] for r in want) > 3000
    assert sorted(tuple(r) for r in substrings.dedup(make_docs(rows)).collect()) == want
    assert substrings.dedup(make_docs([])).count() == 0


def test_substrings_of_few_letters(make_docs):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ab", [9, 1], k=rng.randint(50, 900)))) for i in range(12)]
    rows += [(20, "ab" * 300), (21, "aab" * 200), (22, rows[0][1][::-1] + "ab" * 120)]
    assert sorted(tuple(r) for r in substrings.dedup(make_docs(rows)).collect()) == brute_substrings(rows)


def test_one_id_with_several_texts(make_docs):
    """The text with the smallest hash is the document; the others lose nothing, and nothing is lost to them."""
    rng = random.Random(12)
    own = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    shared, line = own(240), own(130)
    rows = [(i, f"{own(60)}{shared}{own(90)}{line}") for i in range(8)]
    rows += [(3, f"{own(200)}{shared}{line}"), (3, shared), (5, line * 3), (5, rows[5][1]), (9, None), (9, own(20)), (10, line), (10, line)]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    smallest = {i: min((t or "" for j, t in rows if j == i), key=sha) for i, _ in rows}
    documents = [(i, t) for i, t in rows if (t or "") == smallest[i]]
    aside = [(i, len(t.encode()), 0, 0, sha(t)) for i, t in ((i, t or "") for i, t in rows) if t != smallest[i]]
    want = sorted(brute_substrings(documents) + aside)
    assert len(aside) >= 4
    for hot in (substrings.HOT, 4, 0):
        assert sorted(tuple(r) for r in substrings.dedup(make_docs(rows), hot=hot).collect()) == want


def test_hot_anchors_are_dealt_out_by_strings(make_docs):
    """A line and a longer passage that all documents hold, amid text of their own."""
    rng = random.Random(9)
    own = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line, passage = own(80), own(330)
    rows = [(i, f"{own(150)}{line}{own(rng.randint(90, 160))}{passage if i % 3 else passage[:-7]}{own(120)}") for i in range(60)]
    rows += [(70, rows[4][1]), (4, rows[4][1]), (-3, passage)]
    want = brute_substrings(rows)
    for hot in (substrings.HOT, 20, 0):
        assert sorted(tuple(r) for r in substrings.dedup(make_docs(rows), hot=hot).collect()) == want
    assert sorted(tuple(r) for r in substrings.dedup(make_docs(corpus(5)), hot=1).collect()) == brute_substrings(corpus(5))


def test_hot_line_makes_no_group():
    rng = random.Random(10)
    own = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line = own(99)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(90)), "text": [own(120) + line + own(120) for _ in range(90)]})
    anchors = pa.Table.from_batches(substrings._anchor_rows(iter([batch]))).to_pylist()
    grams = Counter(r["gram"] for r in anchors)
    assert max(grams.values()) == 90
    wanted = [[{"gram": r["gram"], "spot": r["spot"], "hot": True} for r in anchors if r["doc"] == i and grams[r["gram"]] == 90] for i in range(90)]
    regions = pa.Table.from_batches(substrings._context_rows(iter([batch.append_column("wanted", pa.array(wanted))]))).to_pylist()
    assert max(Counter((r["gram"], r["string"]) for r in regions if r["gram"] is not None).values()) == 1


def test_long_text_in_stretches(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choices("abcd ", k=30_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [3], "text": [text]})
    whole = pa.Table.from_batches(substrings._anchor_rows(iter([batch])))
    monkeypatch.setattr(substrings, "STEP", 1000)
    pieces = pa.Table.from_batches(substrings._anchor_rows(iter([batch])))

    def strings(table):
        kept = table.filter(table.column("region").is_valid())
        at, back, more = substrings._unpacked(kept.column("spot").to_numpy())
        return sorted((a - b + k, a, g) for g, a, b, m in zip(kept.column("gram").to_pylist(), at.tolist(), back.tolist(), more.tolist()) for k in range(m + 1))

    assert strings(whole) == strings(pieces)
    assert [s for s, _, _ in strings(whole)] == list(range(len(text) - 99))


def test_suffix_sort_is_a_sort():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(200)]
    group = np.sort(np.array([rng.randint(0, 9) for _ in texts]))
    length = np.array([len(t) for t in texts])
    order = substrings.suffix_sort(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length, group)
    assert order.tolist() == sorted(range(200), key=lambda i: (group[i], texts[i], i))


def test_colliding_hashes_do_not_mislead(monkeypatch):
    monkeypatch.setattr(substrings.PrefixHashes, "of", lambda self, a, b: (b - a).astype(np.uint64))
    texts = [b"b", b"a", b"ab", b"aa"]
    order, common = substrings._classes(texts, np.zeros(4, int))
    assert [texts[i] for i in order] == sorted(texts) and common.tolist() == [-1, 1, 1, 0]


def test_encoder_equals_the_library():
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "ñ", "1", "23", ".", "###", "'s", "'", "ß", "×", "²", "\xa0", "日", "\x1c", "<|endoftext|>", "don't", " the", "\r\n", "_", "\x85", "\x7f", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + [None, ""]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = Encoder().encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, bounds[1:-1])):
        assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_packing_keeps_every_id_once(make_docs):
    rows = corpus(10)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(make_docs(rows)).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, all_ids in texts.items():
        if len(all_ids) > 1 and len(set(map(tuple, all_ids))) > 1:
            assert sum(r.length for r in pieces[i]) == sum(map(len, all_ids))
            continue
        spots = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i])
        ids, covered = all_ids[0], defaultdict(int)
        for start, length, crc, tokens in spots:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and tokens == len(ids)
            for k in range(start, start + length):
                covered[k] += 1
        assert covered == {k: len(all_ids) for k in range(len(ids))}
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two
    assert packing.pack(make_docs([])).count() == 0


def test_hilbert_is_a_curve():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    index = packing.hilbert(grid, 3)
    assert sorted(index.tolist()) == list(range(512))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_counts(spark, make_docs):
    rows = corpus(11) + [(900, "<|endoftext|> stays text"), (901, None), (902, None)]
    folder = scratch_table(spark, "tokens")
    written = tokenfiles.write_token_files(make_docs(rows), folder)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = sorted((i is None, i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for block in (64, 1 << 20):
        got = tokenfiles.count_tokens(spark, folder, block=block).join(written, ["file", "ordinal"]).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want
        assert all(r.closed for r in got)


def test_separator_scan_of_odd_files(spark, tmp_path):
    files = {"empty": [], "one": [9], "none": [1, 2, 3], "open": [9, 9, 1, 9, 2, 2, 2, 2, 2, 2, 2], "ends": [1, 9, 9]}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    want = set()
    for name, ids in files.items():
        n = k = 0
        for x in ids:
            if x == 9:
                want.add((f"{name}.bin", k, n, True))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            want.add((f"{name}.bin", k, n, False))
    for block in (2, 4, 6, 1024):
        assert {tuple(r) for r in tokenfiles.count_tokens(spark, str(tmp_path), separator=9, block=block).collect()} == want
