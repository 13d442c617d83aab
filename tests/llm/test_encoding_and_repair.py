"""BPE by a trie, alignment of two tokenisers and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import conversation_repair, queries, token_alignment, trie_bpe

DOCS = "doc_id bigint, text string, k string, t bigint, ids string, `end` int"
PARTS = [*"abcdefgh ABC 0129 '\"_-.,;!?\t\n\r\x0b\x1c\x00\x7f\x85\xa0²¼ªÉéßÀİıſΣσ日本👍🏽́ﬁ①​　▁",
         "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "'ll", " the ",
         "rendezvous", "aaaa", "haha", "😀😀", "ing", "tion"]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["a" * n for n in range(1, 40)] + ["ha" * n for n in range(1, 30)] + ["!" * 77, " " * 50]
    return out + ["".join(rng.choice("abn") for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    some = [(i, t) for i, t in enumerate(texts(n=120))]
    return some + [some[3], (3, "again"), (None, "none"), (None, None), (900, None), (901, ""),
                   (902, "x" * 40_000), (903, "the cat " * 4000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "i", 2) for r in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("nodes", [50, trie_bpe.MAX_NODES])
def test_trie_gives_the_tokenizers_ids(word_bpe, nodes):
    codec = trie_bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), nodes)
    given = texts()
    got = [x for i in range(0, len(given), 7) for x in codec.encode(given[i:i + 7])]
    assert got == [ids_of(word_bpe, t) for t in given]
    assert [codec.decode(x) for x in got] == [
        word_bpe.decode(list(array("I", x)), skip_special_tokens=False) for x in got]


def test_long_words_need_no_trie(word_bpe, monkeypatch):
    monkeypatch.setattr(trie_bpe, "LONG_WORD", 3)
    codec = trie_bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    assert codec.encode(["rendezvous abab the a"]) == [ids_of(word_bpe, "rendezvous abab the a")]
    assert len(codec.trie) < 10


def test_prefixes_are_encoded_once():
    codec = trie_bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.encode(["abcd abce abc"])
    # root, a, ab, abc and the three word ends: c, d, e
    assert len(codec.trie) == 7


def test_round_trip(docs, rows, word_bpe):
    got = trie_bpe.round_trip(docs).collect()
    want = []
    for i, t in rows:
        ids = ids_of(word_bpe, t)
        want.append((i, len(ids) // 4, ids, word_bpe.decode(list(array("I", ids)),
                                                            skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0], r[2])
    assert sorted([(r[0], r[1], bytes(r[2]), r[3]) for r in got], key=order) == sorted(want, key=order)
    again = trie_bpe.decode_ids(trie_bpe.encode_texts(docs)).collect()
    assert sorted((r.decoded for r in again)) == sorted(w[3] for w in want)


def test_decode_unknown_and_null_ids(spark):
    df = spark.createDataFrame([("a", None), ("b", array("I", [320, 99_999, 49_407]).tobytes())],
                               "doc_id string, ids binary")
    got = dict(trie_bpe.decode_ids(df).collect())
    assert got == {"a": "", "b": "a</w> <|endoftext|>"}


# ---------------------------------------------------------------- alignment

@pytest.fixture(scope="module")
def sides():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    aligner = token_alignment.Aligner()
    return (tokenizer, aligner.model, token_alignment.token_bytes_a(),
            token_alignment.token_bytes_b(aligner.model))


def intervals(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def brute_alignment(text, sides):
    tokenizer, model, of_a, of_b = sides
    if not text:
        return [], [], [], 0
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b, whole = model.encode(text), (" " + text).encode()
    if b"".join(of_a[i] for i in a) != whole or b"".join(of_b[i] for i in b) != whole:
        return [], [], [], 0
    a, b = intervals(a, of_a), intervals(b, of_b)
    groups, low = [], 0
    for cut in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
        part = ["|".join([",".join(str(i) for s, e, i in side if low <= s and e <= cut)
                          for side in (a, b)])]
        groups += part
        low = cut
    links = [(i, j) for _, e, i in a for _, f, j in b if e == f]
    return (a, b, [groups, links], sum(s < f and t < e for s, e, _ in a for t, f, _ in b))


def test_alignment(spark, docs, rows, sides):
    rows = [r for r in rows if len(r[1] or "") < 1000]
    docs = docs.where("coalesce(length(text), 0) < 1000")
    found = token_alignment.align(docs)
    scored = token_alignment.score_links(found, token_alignment.link_counts(found)).collect()
    brute = [(i, brute_alignment(t, sides)) for i, t in rows]
    count: dict = {}
    for _, (_, _, x, _) in brute:
        for link in (x[1] if x else []):
            count[link] = count.get(link, 0) + 1
    top: dict = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    want = []
    for i, (a, b, x, over) in brute:
        groups, links = x or ([], [])
        want.append((i, len(a), len(b), len(groups), len(links), over, ";".join(groups),
                     sum(count[link] == top[link[1]] for link in links), sum(count[link] for link in links)))
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_overlaps, r.groups, r.n_best,
            r.count_sum) for r in scored]
    assert sum(w[1] == 0 for w in want) > 5
    order = lambda r: (r[0] is None, *r[:1], r[6])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_groups_cover_long_texts(docs, sides):
    long = token_alignment.align(docs.where("doc_id = 902 OR doc_id = 903")).collect()
    for r in long:
        a = [int(i) for g in r.groups.split(";") for i in g.split("|")[0].split(",")]
        b = [int(i) for g in r.groups.split(";") for i in g.split("|")[1].split(",")]
        assert (len(a), len(b), r.n_groups) == (r.n_a, r.n_b, r.groups.count(";") + 1)
        assert b"".join(sides[2][i] for i in a) == b"".join(sides[3][i] for i in b)


def test_coalescing_of_intervals():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 2, 6, 7, 8, 9])
    group_a, group_b = token_alignment.coalesce(a, b)
    assert group_a.tolist() == [0, 1, 1, 2] and group_b.tolist() == [0, 0, 1, 2, 2, 2]
    x, y = token_alignment.overlaps(a, b)
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3), (3, 4), (3, 5)]


def test_linked_pairs_are_bounded(sides):
    a, b = [x for x in sides[2] if x], [x for x in sides[3] if x]
    brute = sum(x.endswith(y) or y.endswith(x) for x in a[300:500] for y in b[1000:1200])
    assert token_alignment.pair_bound(a[300:500], b[1000:1200]) == brute
    assert token_alignment.pair_bound(a, b) == 324_297


# ---------------------------------------------------------------- conversations

def damage(rows):
    out = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if hit:
            x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
            out += [(c, t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    return out


def by_conversation(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)))
    return out


STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                       hashlib.md5(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = re.sub("[\x20\x09-\x0d]+$", "", text)
        faults.append("b" if not shown else "d" if (role, text) in seen
                      else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    then: dict = {}
    for i in range(len(rows), -1, -1):
        def best(state, inserted=0):
            ways = []
            if i == len(rows) and state in ("", "a"):
                ways.append((0, "", ()))
            if inserted < 2:
                for c, role in (("u", "user"), ("a", "assistant")):
                    if (state, c) in STEP:
                        n, s, out = best(STEP[state, c], inserted + 1)
                        ways.append((n + 5, "I" + s, ((role, ""),) + out))
            if i < len(rows):
                role, text = rows[i][2:]
                more = 5 if faults[i] == "t" else 0
                n, s, out = then[state]
                ways.append((n + 2, "D" + s, out))
                if faults[i] not in ("b", "d"):
                    for c, name, cost, letter in ((role[:1], role, 0, "K"), ("u", "user", 1, "R"),
                                                  ("a", "assistant", 1, "R")):
                        if (state, c) in STEP:
                            n, s, out = then[STEP[state, c]]
                            ways.append((n + cost + more, letter + s, ((name, text),) + out))
            return min(ways) if ways else (10 ** 9, "", ())
        then = {state: best(state) for state in ("", "s", "u", "a")}
    cost, audit, out = then[""]
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit), out


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), None]:
        n = rng.choice([0, 1, 3, 8, 40, 120])
        rows += [(c, rng.choice([i, i, i, None, rng.randint(0, n)]),
                  rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]),
                  rng.choice(["a.", "b", "", "c!", None, " \t", f"x{i}.", f"y{i}", f"z{i}? ", "x"]))
                 for i in range(n)]
    rows += [(1000, i, "user", "hot") for i in range(300)]
    rows += [(1001, i, "tool", f"t{i}") for i in range(200)]
    return rows + [(1002, 1, "user", "same.")] * 300


@pytest.mark.parametrize("chunk, fixups", [(3, 0), (7, 2), (5, 30), (4096, 6)])
def test_repairs_equal_brute_force(spark, chunk, fixups):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string,"
                               " text string, codes string, id int").repartition(5)
    edits = conversation_repair.plan_repairs(df, chunk=chunk, fixups=fixups)
    numbers = {r[0]: tuple(r)[1:] for r in conversation_repair.summary(df, edits).collect()}
    audits = {r[0]: tuple(r)[1:] for r in conversation_repair.audits(df, edits).collect()}
    turns: dict = {}
    for r in sorted(conversation_repair.repaired_turns(df, edits).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    sys.setrecursionlimit(10_000)
    given = by_conversation(rows)
    assert set(audits) == set(given)
    for c, x in given.items():
        want, out = brute_repair(x)
        assert (*numbers[c], *audits[c][:2]) == want, c
        assert turns.get(c, []) == list(out)
        joined = "\n".join(f"{r}:{t}" for r, t in out)
        assert audits[c][2] == hashlib.sha256(joined.encode()).hexdigest()


def test_vectors_converge():
    codes = bytes([conversation_repair.USER, conversation_repair.ASSISTANT] * 50)
    true = conversation_repair.begin_costs(codes, conversation_repair.END)
    begin = conversation_repair.begin_costs(codes, (0, 0, 0, 0))
    assert conversation_repair.fixed_up(codes, (0, 0, 0, 0), begin, conversation_repair.END) == true
    m = conversation_repair.matrix(codes)
    assert conversation_repair.level((m + np.array(conversation_repair.END)).min(axis=1)) == true


def test_repair_query(spark, tmp_path):
    rows = conversations(7)
    (spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
     .write.parquet(str(tmp_path / "conversations.parquet")))
    got = {r[0]: tuple(r)[1:] for r in
           queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    damaged = by_conversation(damage(rows))
    assert set(got) == {r[0] for r in rows}
    for c in got:
        want, out = brute_repair(damaged.get(c, []))
        joined = "\n".join(f"{r}:{t}" for r, t in out)
        assert got[c] == (*want, hashlib.sha256(joined.encode()).hexdigest()), c


def test_empty_tables_of_new_operators(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert trie_bpe.round_trip(docs).count() == 0
    found = token_alignment.align(docs)
    assert token_alignment.score_links(found, token_alignment.link_counts(found)).count() == 0
    schema = "conv_id string, turn int, role string, text string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).count() == 0


def test_queries_of_new_operators(spark, tmp_path, word_bpe):
    rows = [(i, t) for i, t in enumerate(texts(n=20))] + [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_bpe"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = ids_of(word_bpe, t)
        text = word_bpe.decode(list(array("I", ids)), skip_special_tokens=False)
        assert tuple(got[i]) == (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                 hashlib.sha256(text.encode()).hexdigest())
    found = queries.QUERIES["op13_token_alignment"](spark, str(tmp_path))
    digests = {r.doc_id: r for r in found.collect()}
    groups = {r.doc_id: r.groups for r in token_alignment.align(
        spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    assert found.where(F.col("n_a") == 0).count() >= 2
    for i, _ in rows:
        want = hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else ""
        assert digests[i].groups_sha256 == want
