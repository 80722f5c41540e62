"""Text operators against brute force on small tables with nulls, empty and repeated rows, ties and extra columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import chat, decontamination, graph, langid, lm_scoring, ngram_join, packing, quality, sharding, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, nulls, empties, repeats and a long one."""
    rng = random.Random(seed)
    words = [a + b for a in "ka lo mi ne pu ti".split() for b in "ra se vo zu".split()] + ["the", "of", "and"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(n)]
    base = rng.choices(words, k=70)
    for i in range(12):
        near = list(base)
        near[rng.randrange(70)] = f"changed{i % 4}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + [None, "", " \n\t ", "one", "a b c", "A B C", "a\x0bb\x0cc d", "é ß ñ", " ".join(rng.choices(words, k=4000))]
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# packing


def test_fast_encoder_gives_the_reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x250, 64)] + ["a<|endoftext|>b", "x\x1c\x1d y\x85z\xa0w", "don't  we'll\n\n 42x", "日本 🙂 Ωμέγα", "‘q’ — … “x”"]
    for t in texts:
        assert packing.encode(t) == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once_without_overlap(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(30, 60), 34, 50]) for _ in range(400))
    runs = packing.plan_bins(dict(counts), 100)
    taken, placed = collections.defaultdict(list), collections.Counter()
    for n, first, start, fit, offset in sorted(runs):
        upto = min((r[1] for r in runs if r[0] == n and r[1] > first), default=counts[n])
        for rank in range(first, upto):
            step, place = divmod(rank - first, fit)
            taken[start + step].append((offset + place * n, n))
            placed[n] += 1
    assert placed == counts
    for places in taken.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 100
    # large items are paired as well as a maximal matching can
    assert len(taken) <= max(math.ceil(sum(n * c for n, c in counts.items()) / 100) * 1.25, sum(c for n, c in counts.items() if n > 50) + 6)


def test_packing_round_trip(docs, rows):
    out = packing.pack_documents(docs.withColumn("length", F.lit(1)), 64).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    assert len(pieces) == len(rows)
    for i, text, *_ in rows:
        ids = packing.encode(text or "") + [0]
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert r.piece == k and len(part) == r.length and (r.length == 64 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in pieces[i]) == len(ids)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64


def test_sequences_hold_the_ids(docs, rows):
    total = sum(len(packing.encode(t or "")) + 1 for _, t, *_ in rows)
    out = packing.sequences(docs, 256).collect()
    assert sum(len(r.ids) for r in out) == total and max(len(r.ids) for r in out) <= 256


def test_cut_shortens_only_the_first_piece():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


# quality


def plain_counts(text):
    words, t = WORD.findall(text or ""), text or ""
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_counts(spark, rows):
    more = [(900, "x y z x y z\nx y\nx y\n \n|a|b #", "en", "s", 1), (901, "a a a a", "en", "s", 1), (902, "a|b|c " * 40, "de", "s", 1)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows + more, SCHEMA)).collect()}
    for i, text, *_ in rows + more:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text), i
        assert not (r.base_failed and r.kept)


def test_quality_drops_symbols_and_keeps_prose(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(150)) + "."
    rows = [(i, prose(), "en", "s", 0) for i in range(30)] + [(99, " ".join(f"{w}***&&&" for w in prose().split()), "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("theirs"))
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(range(30))


def test_js_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0],), ([1.0, 0.0, 0.0],)], "p array<double>")
    same, far = (r[0] for r in df.select(quality.js_distance(F.col("p"), [0.5, 0.5, 0.0])).collect())
    assert same < 1e-9 and 0.5 < far < 0.6


# sharding


def test_differencing_balances_and_keeps_parts():
    rng = random.Random(5)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    final = sharding.difference([(s, 0, 0, 0) for s in sizes])
    assert all(sorted(row) == [0, 1, 2, 3] for row in final.tolist())
    sums = [sum(s for s, row in zip(sizes, final, strict=True) if row[0] == k) for k in range(4)]
    assert max(sums) - min(sums) <= 2


def test_shards_of_more_groups_than_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", 8)
    rng = random.Random(2)
    groups = spark.createDataFrame([(f"k{i}", rng.randint(1, 2000)) for i in range(700)], "key string, bytes long")
    load = collections.Counter()
    for r in sharding.assign_groups(groups, 4).join(groups, "key").collect():
        load[r.shard] += r.bytes
    assert sum(load.values()) == groups.agg(F.sum("bytes")).first()[0] and max(load.values()) - min(load.values()) < 500


@pytest.mark.parametrize("fan_in", [4096, 2])
def test_shards(docs, rows, fan_in, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", fan_in)
    out = sharding.shard_documents(docs, 4).collect()
    assert sorted(r.doc_id for r in out) == [i for i, *_ in rows]
    texts = {i: t or "" for i, t, *_ in rows}
    where = collections.defaultdict(set)
    load = collections.Counter()
    for r in out:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        where[texts[r.doc_id]].add(r.shard)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values())
    for k in range(4):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots)))


# token counts


@pytest.mark.parametrize("mark", ["", "##"])
def test_automaton_is_greedy_longest_match(mark):
    rng = random.Random(7)
    for _ in range(400):
        vocabulary = {"a", "b", "c"} | {"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(8)}
        inner = {mark + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(8)} if mark else set()
        automaton = token_counts.Automaton(vocabulary | inner, mark)
        word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        n, at = 0, 0
        while n is not None and at < len(word):
            ends = [e for e in range(at + 1, len(word) + 1) if (mark if at else "") + word[at:e] in vocabulary | inner]
            n, at = (n + 1, max(ends)) if ends else (None, at)
        assert automaton.count(word) == n


def test_token_counts_of_documents(docs, rows):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs.withColumn("n_words", F.lit(0))).collect()}
    pieces = langid.pieces().number
    for i, text, *_ in rows[:20] + rows[-8:]:
        total = 0
        for word in (text or "").split():
            w, at = "▁" + word, 0
            while at < len(w):
                ends = [e for e in range(at + 1, len(w) + 1) if w[at:e] in pieces]
                total += 1 if ends else len(w[at].encode())
                at = max(ends, default=at + 1)
        assert got[i].n_pieces == total


# n-gram join


def plain_groups(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "salt", "block"), [(4, 85, 10**6, 32), (5, 80, 2, 3)])
def test_ngram_groups(docs, rows, k, percent, salt, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs, k, percent, salt_above=salt).collect()}
    assert got == plain_groups(rows, k, percent)


def test_near_copies_of_a_large_group(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()}
    assert got == {i: c for i, (_, c) in plain_groups(rows, 4, 85).items()}


@pytest.mark.parametrize("held", [1024, 16])
def test_texts_of_common_paragraphs_open_few_pairs(spark, held, monkeypatch):
    rng = random.Random(8)
    paragraphs = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(paragraphs, 6)), "en", "s", 0) for i in range(150)]
    rows += [(500 + i, rows[i][1] + f" more{i}", "en", "s", 0) for i in range(20)]
    opened, write = [], ngram_join.materialize

    def counted(df, tag="t"):
        out = write(df, tag)
        if tag == "open":
            opened.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()}
    assert got == plain_groups(rows, 5, 80)
    assert sum(opened) <= len(rows)


def test_bit_maps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 1 << 63, 600).astype(np.uint64)
        u, v = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        between = len(u) + len(v) - 2 * len(np.intersect1d(u, v))
        assert ngram_join.apart([ngram_join.parities(u)], [ngram_join.parities(v)])[0] <= between
    assert ngram_join.most_apart(100, 100, 80) == 22


def test_keep_first_keeps_one_of_each_group(docs, rows):
    left = sorted(r.doc_id for r in ngram_join.keep_first(docs, 5, 80).collect())
    assert left == [i for i, (_, c) in sorted(plain_groups(rows, 5, 80).items()) if i == c]


@pytest.mark.parametrize("per_task", [10**6, 40])
def test_components(spark, per_task):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()}
    assert got == {v: root(v) for a, b in edges if a != b for v in (a, b)}


# chat


def test_quotations_are_linked_and_cut(spark):
    said = [
        (1, 0, "user", "Where is the blue key?\nI lost it."),
        (1, 1, "assistant", "> Where is the  blue KEY?\nOn the table."),
        (1, 2, "user", "> > Where is the blue key?\n> On the table.\nThanks!"),
        (1, 3, "assistant", "> I lost it.\nSorry to hear that."),
        (1, 4, "user", None),
        (2, 0, "user", "> Sorry to hear that.\nWho said it?"),
        (2, 1, "user", "> nobody said this\n\n"),
        (2, 2, "user", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.threads(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit(7))).collect()}
    assert len(got) == len(said)
    assert got[1, 1].own_text == "On the table." and (got[1, 1].parent_turn, got[1, 1].thread, got[1, 1].depth) == (0, 0, 1)
    assert got[1, 2].own_text == "Thanks!" and got[1, 2].quote_level == 2 and (got[1, 2].parent_turn, got[1, 2].thread, got[1, 2].depth) == (1, 0, 2)
    assert got[1, 3].parent_turn == 0
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].thread, got[2, 0].depth) == (1, 3, 0, 0)
    assert got[2, 1].n_quoted == 1 and got[2, 1].parent_turn is None and got[2, 1].own_text == ""
    assert got[1, 4].own_text == "" and got[2, 2].own_text == ""


def test_passages_of_other_conversations(spark):
    line = "This is a passage that more than one conversation has."
    said = [
        (1, 0, "user", f"> {line}\nAnyone?"), (1, 1, "assistant", line), (2, 0, "user", line), (3, 0, "user", "> yes\nReally?"), (4, 0, "user", "yes"), (5, 0, "user", "yes"), (5, 1, "assistant", "> yes\nGood."),
        (5, 2, "user", "Something else."), (5, 3, "user", "> Good.\nThanks."), (2, 0, "user", line), (None, 0, "user", f"> {line}\nNo id."), (6, None, "user", "no turn"),
    ]
    table = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x"))
    placed = chat.threads(table)
    rows = placed.collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(said)
    assert (got[1, 0].parent_conv, got[1, 0].parent_turn) == (2, 0) and got[3, 0].parent_conv is None
    assert (got[5, 1].parent_conv, got[5, 1].parent_turn) == (5, 0)
    assert [r.turn for r in sorted((r for r in rows if r.conv_id == 5), key=lambda r: r.position)] == [0, 1, 3, 2]
    assert sorted(r.position for r in rows if r.conv_id == 2) == [0, 1] and got[None, 0].position is None
    talk = {(r.conv_id, r.block): r.messages for r in chat.assemble(placed, 2).collect()}
    assert [m.text for m in talk[5, 0]] == ["yes", "Good."] and [m.text for m in talk[5, 1]] == ["Thanks.", "Something else."]


def test_planted_quotations_match_sql(spark):
    import duckdb

    rng = random.Random(3)
    said, lines = [], []
    for conv in range(12):
        for turn in range(rng.randint(2, 7)):
            own = " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rng.randint(1, 7)))
            quote = "".join(f"> {x}\n" for x in rng.sample(lines, min(len(lines), rng.randint(0, 2))))
            said.append((conv, turn, rng.choice(["user", "assistant"]), quote + own))
            lines.append(own)
    conversations = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = chat.threads(conversations).toPandas()
    con = duckdb.connect()
    con.register("conversations", conversations.toPandas())
    want = con.execute(chat.OP6_SQL).df()
    assert (got.parent_conv.notna()).sum() > 10
    key = ["conv_id", "turn"]
    got, want = got.sort_values(key, ignore_index=True), want[got.columns].sort_values(key, ignore_index=True)
    for c in got:
        assert (got[c].fillna(-1).astype(str).str.replace(".0", "") == want[c].fillna(-1).astype(str).str.replace(".0", "")).all(), c


def test_very_long_messages(spark):
    text = "\n".join(("> " if i % 2 else "") + f"line {i} with some words" for i in range(20_000))
    row = chat.threads(spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "> line 0 with some words\nyes")], "conv_id long, turn long, role string, text string")).where("turn = 0").first()
    assert row.n_quoted == 10_000 and row.own_text.count("\n\n") == 9_999


# language identification


def test_long_words_are_learned_whole():
    vocabulary = langid.pieces()
    base = np.array([32.0 ** len(p) / vocabulary.size for p in vocabulary.number] + [1e-7])
    lengths = np.array([len(p) for p in vocabulary.number] + [1])
    word = "▁" + "nationality" * 90
    numbers, amounts = langid.expected(vocabulary.grid([word], len(word)), base, np.array([2.0]))
    assert abs((lengths[numbers] * amounts).sum() - 2 * len(word)) < 1e-6 * len(word)
    grid = vocabulary.grid([word], len(word))
    weights = np.random.default_rng(2).random((vocabulary.size + 1, 2)) * 1e-4
    assert np.allclose(langid._forward_one(grid[0], weights), langid.forward(np.concatenate([grid, grid]), weights)[0])


def test_numbers_of_other_categories_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "la casa verde", "es", "s", 0), (1, "the green house", "en", "s", 0), (2, "½ ² ① Ⅷ", "es", "s", 0), (3, "x" * 200_000, None, "s", 0), (None, "the green house", None, "s", 0), (1, "the green house", "en", "s", 0)], SCHEMA)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, langid.train(docs.where("doc_id < 2"))).collect()]
    assert (2, "und") in got and (None, "en") in got and got.count((1, "en")) == 2 and len(got) == 6


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces()
    rng = np.random.default_rng(1)
    weights = rng.random((vocabulary.size + 1, 2)) * 1e-3
    for word in ["▁the", "▁lation", "▁x一yz", "▁" + "ab" * 40]:

        def total(w, memo={}):  # noqa: B006
            out = np.zeros(2) if w else np.ones(2)
            for k in range(1, len(w) + 1):
                number = vocabulary.number.get(w[:k], vocabulary.size if k == 1 else None)
                if number is not None:
                    rest = memo.get(w[k:])
                    if rest is None:
                        rest = memo[w[k:]] = total(w[k:], memo)
                    out = out + weights[number] * rest
            return out

        got = langid.forward(vocabulary.grid([word], len(word)), weights)[0]
        want = total(word, {})
        if (want > 1e-280).all():
            assert np.allclose(got, np.log(want), rtol=1e-9)
        assert np.isfinite(got).all()


def test_expected_uses_add_up():
    vocabulary = langid.pieces()
    base = np.array([32.0 ** len(p) / vocabulary.size for p in vocabulary.number] + [1e-7])
    numbers, amounts = langid.expected(vocabulary.grid(["▁lation", "▁nation"], 7), base, np.array([2.0, 1.0]))
    lengths = np.array([len(p) for p in vocabulary.number] + [1])
    assert abs((lengths[numbers] * amounts).sum() - 21) < 1e-9


def test_language_of_held_out_texts(spark):
    rng = random.Random(4)
    make = lambda words: " ".join(rng.choices(words.split(), k=12))
    kinds = {"en": "the house of water and stone is green", "de": "das haus und der stein ist grün wasser", "es": "la casa de agua y piedra es verde"}
    rows = [(i, make(kinds[k]), k if i < 60 else None, "s", 0) for i, k in enumerate(list(kinds) * 40)] + [(500, None, "en", "s", 0), (501, "123 !!", None, "s", 0), (502, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("x")), langid.train(docs.where("doc_id < 60"))).collect()}
    right = sum(got[i].lang_pred == k for i, k in enumerate(list(kinds) * 40))
    assert right >= 118 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3


# decontamination

ITEM = "A train leaves Boston at 40 km per hour and meets another train from Denver that goes 60 km per hour so when do they meet on the way"


def test_reparameterised_items_are_found(spark):
    swapped = ITEM.replace("Boston", "Madrid").replace("Denver", "Lisbon").replace("40", "75").replace("60", "90")
    broken = ITEM.replace("Boston", "Madrid").replace("from Denver", "from Madrid")
    rng = random.Random(9)
    noise = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(60))
    rows = [(0, f"{noise()} {ITEM} {noise()}", "en", "s", 0), (1, f"{noise()} {swapped}", "en", "s", 0), (2, noise(), "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, ITEM[:60], "en", "s", 0), (6, f"{noise()} what is two plus two now {noise()}", "en", "s", 0), (7, broken, "en", "s", 0)]
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "what is two plus nine now"), (13, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    for limit in (10**6, 0):
        got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items, max_filter=limit).collect()}
        assert got - {(7, 10)} == {(0, 10), (1, 10), (6, 12)}
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {2, 3, 4, 5} <= {r.doc_id for r in left.collect()} <= {2, 3, 4, 5, 7}


@pytest.mark.parametrize("change", [str.upper, str.lower, str.title])
def test_recased_items_are_found(spark, change):
    item = "The dog of Anna saw a cat. It ran away from there. Then the old man came home. Is the Straße near us?"
    docs = spark.createDataFrame([(0, f"some other words {change(item)} and more", "en", "s", 0), (1, change("the dog of anna saw a cat it ran away"), "en", "s", 0)], SCHEMA)
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    for limit in (10**6, 0):
        assert [(r.doc_id, r.item_id, r.covered) for r in decontamination.matches(docs, items, max_filter=limit).collect()] == [(0, 10, 23)]


def test_items_of_names_and_numbers_are_found(spark):
    texts = ["Who wrote Romeo and Juliet in 1597?", "Anna Berg Paul Stein Mary Jones Tom Smith Eva Klein Max Gross", "12 + 7 = 19 and 30 - 4 = 26 or 5 * 5 = 25 so 8 / 2 = 4"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([*[(i, f"some words before {x} and some after", "en", "s", 0) for i, x in enumerate(texts)], (3, "Who wrote Emma and Persuasion in 1815? Tom Smith Eva Klein", "en", "s", 0)], SCHEMA)
    for limit in (10**6, 0):
        assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items, max_filter=limit).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_a_changed_name_before_does_not_shorten_a_copy():
    places = [(0, ["3:x"], ["3:y"]), *[(i, [], []) for i in range(1, 4)], *[(i, ["3:x"], ["3:x"]) for i in range(4, 7)]]
    assert decontamination._longest(places, 14, 8) == 13


def test_inconsistent_slots_break_a_match():
    good = [(0, ["3:a", "3:b"], ["3:x", "3:y"]), (1, ["3:b"], ["3:y"])]
    bad = [(0, ["3:a", "3:b"], ["3:x", "3:x"])]
    assert decontamination._covered(good, 9, 8) == 9 and decontamination._covered(bad, 9, 8) == 0


def test_short_items_and_other_spaces(spark):
    items = spark.createDataFrame([(1, "blue key"), (2, "where is\u00a0the old key"), (3, "it weighs twelve kg and costs sixty dollars in all today")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "a Blue key here", "en", "s", 0), (1, "so where is the old key now", "en", "s", 0), (2, "and it weighs fifteen kg and costs ninety dollars in all today ok", "en", "s", 0), (3, "blue old keys", "en", "s", 0), (None, "a blue key", "en", "s", 0), (None, "clean", "en", "s", 0), (0, "clean too", "en", "s", 0), (4, "blue key " * 50_000, "en", "s", 0)], SCHEMA)
    for limit in (10**6, 0):
        got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items, max_filter=limit).collect()}
        assert got == {(0, 1), (1, 2), (2, 3), (None, 1), (4, 1)}
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in decontamination.drop_contaminated(docs.withColumn("item_id", F.lit(1)), items).collect())
    assert left == [(-1, "clean"), (0, "clean too"), (3, "blue old keys")]


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [a + b for a in "ka lo mi ne".split() for b in "ra se vo".split()]
    name, number = (lambda: rng.choice(["Anna", "Boris", "Clara", "David"])), (lambda: str(rng.randint(1, 99)))
    fill = lambda shape: [w if w not in "NM" else name() if w == "N" else number() for w in shape]
    shapes = [[rng.choice(words) if rng.random() < 0.8 else rng.choice("NM") for _ in range(rng.randint(8, 20))] for _ in range(8)]
    items = [(i, " ".join(fill(s))) for i, s in enumerate(shapes)]
    rows = []
    for d in range(40):
        shape = rng.choice(shapes)
        at = rng.randint(0, 3)
        rows.append((d, " ".join(rng.choices(words, k=20) + fill(shape)[at : at + rng.randint(6, 20)] + rng.choices(words, k=20)), "en", "s", 0))

    def plain(doc, item):
        """Longest covered stretch over all offsets, each window compared directly."""
        dw, iw = doc.split(), item.split()
        kind = lambda w: 3 if w[0].isupper() else 1 if w.isdigit() else 0
        best = 0
        for shift in range(-len(iw), len(dw)):
            for literal in (False, True):
                places = []
                for at in range(len(iw) - 7):
                    x, y = iw[at : at + 8], dw[at + shift : at + shift + 8] if at + shift >= 0 else []
                    if len(y) < 8:
                        continue
                    same = [a.lower() for a in x] == [b.lower() for b in y]
                    alike = sum(kind(a) == 0 for a in x) >= 4 and all(kind(a) == kind(b) and (kind(a) or a == b) for a, b in zip(x, y, strict=True))
                    if same or (alike and not literal):
                        slots = lambda w: [f"{kind(a)}:{a.lower()}" for a in w if kind(a)]
                        places.append((at, slots(x), slots(y)))
                best = max(best, decontamination._covered(places, len(iw), 8))
        return best

    got = {(r.doc_id, r.item_id) for r in decontamination.matches(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, text, *_ in rows for i, item in items if plain(text, item) >= min(13, len(item.split()))}
    assert got == want and want


# toxicity


def test_chain_finds_toxic_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = rng.choices(words, k=40) + ([rng.choice(["idiotic", "scummy"])] if toxic else [])
        rows.append((i, " ".join(text), "en", "s", 0))
        if i < 450:
            labels.append((i, 1, int(toxic)))
    docs, table = spark.createDataFrame(rows + [(700, None, "en", "s", 0), (701, "", "en", "s", 0)], SCHEMA), spark.createDataFrame(labels + [(450, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, table)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs.withColumn("is_toxic", F.lit(1)), chain).collect()}
    assert [i for i in range(450, 600) if got[i]] == [i for i in range(450, 600) if i % 6 == 0]
    assert not got[700] and not got[701]
    left = toxicity.drop_toxic(docs, table)
    assert left.columns == docs.columns and left.count() == 502
    assert toxicity.score(docs, toxicity.train(docs, table.limit(0))).count() == 602


def test_later_links_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, 8).astype(np.uint64)) for _ in range(300)]
    first = np.array([float(7 in s) for s in sets])
    chain = toxicity.fit_chain(sets, np.column_stack([first, first]))
    assert chain.links[1].earlier.shape == (1,) and chain.links[1].earlier[0] > 0
    p = chain.predict(sets)
    assert ((p[:, 1] > 0.5) == (first == 1)).mean() > 0.97


# language-model scores


def test_base_scores_and_counts(docs, rows):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs, held).collect()}
    words = {i: [*WORD.findall(lower(t)), None] for i, t, *_ in rows}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = collections.Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    unseen = [i for i in words if out[i]]
    assert sum(got[i].score for i in unseen) > sum(got[i].base_score for i in unseen)


def test_scores_do_not_depend_on_the_frequent_table(docs, monkeypatch):
    held = F.col("doc_id") % 10 == 0
    a = {r.doc_id: r for r in lm_scoring.score_texts(docs, held).collect()}
    monkeypatch.setattr(lm_scoring, "FREQUENT", 8)
    b = {r.doc_id: r for r in lm_scoring.score_texts(docs, held).collect()}
    for i in a:
        assert abs(a[i].base_score - b[i].base_score) < 1e-6 and a[i].n_known == b[i].n_known


def test_model_probabilities_sum_to_one():
    customers, tables = np.zeros(lm_scoring.CONTEXTS), np.zeros(lm_scoring.CONTEXTS)
    rng = np.random.default_rng(3)
    rows = []
    for w in range(2, 40):
        us = sorted(rng.choice(lm_scoring.CONTEXTS, 3, replace=False).tolist())
        cs = rng.integers(1, 30, 3).tolist()
        ts = [min(c, 1 + c // 4) for c in cs]
        np.add.at(customers, us, cs)
        np.add.at(tables, us, ts)
        rows.append({"word": w, "c": sum(cs), "us": us, "cs": cs, "ts": [float(t) for t in ts]})
    m = lm_scoring.Model(sum(r["c"] for r in rows), len(rows), 0.6, 0.5, customers, tables, lm_scoring.Contexts(np.array([5], np.uint64)))
    m.load(rows)
    total = (10.0 ** m.scores.astype(float)).sum(axis=0) + m.back * m.unknown
    assert np.allclose(total, 1, atol=1e-5)


def test_table_counts_follow_the_exact_posterior():
    d, theta_tables = 0.5, np.full(lm_scoring.CONTEXTS, 40.0)
    s = lm_scoring.Seating(d, 0.4, theta_tables)
    rng = np.random.default_rng(1)
    c = np.full(3000, 6)
    word, room = np.arange(3000), np.zeros(3000, int)
    draw = lambda cells, k: rng.random(len(cells))
    t = s.sweep(word, room, c, np.ones(3000, int), draw)
    table = lm_scoring.stirling(10, d)
    weight, total = [], theta_tables.sum()
    for k in range(1, 7):
        x = table[6, k]
        for j in range(k):
            x += math.log(lm_scoring.THETA + d * (39 + j)) - math.log(lm_scoring.THETA_ROOT + total - 1 + j) + (math.log(j - 0.4) if j else 0)
        weight.append(x)
    p = np.exp(np.array(weight) - max(weight))
    p /= p.sum()
    assert np.allclose(np.bincount(t, minlength=7)[1:] / 3000, p, atol=0.04)
    assert (s.sweep(word[:5], room[:5], np.full(5, 5000), np.ones(5, int), draw) >= 1).all()


@pytest.mark.parametrize("parts", [1, 9])
def test_scores_do_not_depend_on_partitions(spark, docs, parts):
    held = F.col("doc_id") % 10 == 0
    want = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, held).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc_id: r.score for r in lm_scoring.score_texts(docs.repartition(parts), held).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(abs(got[i] - want[i]) < 1e-4 * max(1, abs(want[i])) for i in want)


def test_large_dishes_open_as_many_tables_as_single_seating():
    tables = np.full(lm_scoring.CONTEXTS, 40.0)
    s = lm_scoring.Seating(0.6, 0.4, tables)
    rng = np.random.default_rng(5)
    n, c = 400, 3000
    cells = np.arange(n)
    draw = lambda at, k: rng.random(len(at))
    got = s._seat_many(cells, cells, np.zeros(n, int), np.full(n, c), np.ones(n, int), np.full(n, 3.0), draw)
    opened = np.ones(n)
    for seated in range(1, c):
        new = (lm_scoring.THETA + 0.6 * (39 + opened)) * (2 + opened - 0.4) / (lm_scoring.THETA_ROOT + tables.sum())
        opened += rng.random(n) * (new + seated - 0.6 * opened) < new
    assert abs(got.mean() - opened.mean()) < 4 * opened.std() / np.sqrt(n) + 0.02 * opened.mean()


def test_stirling_numbers():
    t = lm_scoring.stirling(4, 0.0)
    assert np.allclose(np.exp(t[4, 1:5]), [6, 11, 6, 1])


class _Sent:
    def __init__(self, value):
        self.value = value


def test_every_word_before_has_a_restaurant_of_its_own(spark):
    """Equally frequent words after equally frequent ones, none of them among the numbered restaurants' words."""
    fill = [f"f{i}" for i in range(80)]
    rows = [(i, " ".join(fill * 4 + [f"a{i % 4}", f"b{i % 4}", "z"]), False) for i in range(1, 41)]
    rows += [(101, "a1 b1", True), (102, "a1 b2", True), (103, "a2 b2", True), (103, "a2 b2", True), (104, None, True), (105, "new b1", True), (None, "a1 b1", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    got = collections.defaultdict(list)
    for r in lm_scoring.score_texts(docs, F.col("out")).collect():
        got[r.doc_id].append(r.score)
    assert len(got[103]) == 2 and got[103][0] == got[103][1] and abs(got[101][0] - got[None][0]) < 1e-9
    assert abs(got[101][0] - got[103][0]) < 0.05  # equal counts; tables elsewhere differ by chance only
    assert got[101][0] > got[102][0] + 1


def test_counts_and_probabilities_after_other_words_equal_plain_ones(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 40) % 30) for _ in range(25)] + [None, ""]
    keys, out = list(range(500, 527)), [i % 5 == 0 for i in range(27)]
    h = [lm_scoring.tokens(t.encode() if t else None) for t in texts]
    frequent = np.sort(np.unique(np.concatenate(h))[::2])
    contexts = lm_scoring.Contexts(lm_scoring.tokens(b"w1 w2")[:2])
    monkeypatch.setattr(lm_scoring, "GATHERED", 300)  # several parts a bucket
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(keys), pa.array(out)], names=["text", "key", "held_out"])
    parts = sorted(lm_scoring._followers(_Sent(contexts), _Sent(frequent), 3)([batch]), key=lambda b: b.column(0)[0].as_py())
    assert len(parts) > 3
    c, size = collections.Counter(), collections.Counter()
    for x, held in zip(h, out, strict=True):
        for u, w, room in zip([lm_scoring.END, *x[:-1].tolist()], x.tolist(), contexts.of(x).tolist(), strict=True):
            if not room and not held:
                c[u, w] += 1
                size[u] += 1
    got = collections.Counter()
    for b in lm_scoring._cell_counts(_Sent(frequent))(parts):
        for w, n, cells in zip(*[col.to_pylist() for col in b.columns], strict=True):
            got[w % 2**64, n] += cells
    assert got == collections.Counter((w, n) for (u, w), n in c.items())
    d, parents = 0.6, rng.uniform(0.001, 0.1, len(frequent))
    t = {k: max(1, min(n, round(n**d))) for k, n in c.items()}
    tables = collections.Counter()
    for (u, _), n in t.items():
        tables[u] += n
    known = dict(zip(frequent.tolist(), parents.tolist(), strict=True))
    want, plain = collections.Counter(), lambda u, w, p: ((c[u, w] - d * t.get((u, w), 0)) + (lm_scoring.THETA + d * tables[u]) * p) / (lm_scoring.THETA + size[u])
    for key, x in zip(keys, h, strict=True):
        for u, w, room in zip([lm_scoring.END, *x[:-1].tolist()], x.tolist(), contexts.of(x).tolist(), strict=True):
            if not room:
                want[key] += math.log10(plain(u, w, known.get(w, 0.02)))
    model = type("M", (), {"d": d, "parents": parents})()
    have = collections.Counter()
    for b in lm_scoring._follow(_Sent(model), _Sent(frequent))(parts):
        for key, s, w, own, back, k in zip(*[col.to_pylist() for col in b.columns], strict=True):
            have[key] += s if w is None else k * math.log10(own + back * 0.02)
    assert set(have) == set(want) and all(abs(have[k] - want[k]) < 1e-9 for k in want)


# empty tables


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert packing.pack_documents(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert token_counts.count_tokens(empty).count() == 0
    assert ngram_join.ngram_groups(empty).count() == 0
    assert chat.threads(talk).count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert decontamination.matches(empty, items).count() == 0
    assert toxicity.drop_toxic(empty, labels).count() == 0
    assert lm_scoring.score_texts(empty, F.col("doc_id") % 10 == 0).count() == 0


def test_null_ids_and_clashing_columns(spark):
    text = "the house of water and stone is green and the tree of life is old and tall today"
    rows = [(None, text, "en", "s", 0), (3, text, "en", "s", 0), (None, "other words here", None, None, None), (3, text, "en", "s", 0), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("is_toxic", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("offset", F.lit(5))
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.ngram_groups(docs).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (4, 4)]
    assert sorted(r.doc_id or -1 for r in ngram_join.keep_first(docs).collect()) == [-1, -1, 3, 4]
    assert packing.pack_documents(docs, 8).select("doc_id").distinct().count() == 3
    assert sharding.shard_documents(docs, 2).count() == 5
    assert lm_scoring.score_texts(docs, F.col("doc_id") % 10 == 0).count() == 5
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and {r.is_toxic for r in left.collect()} == {"x"}
    assert quality.keep_good(docs).columns == docs.columns
