"""Operators that work in Python tasks, against plain versions, round trips and held-out labels."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from telespan.llm import chat, decontaminate, near_dedup, token_counts, toxicity, warc
from tests.llm.fixture import SCHEMA, edited, folder, frame, prose, rows


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- near copies ----


def labelled_kmers(text):
    w = " ".join(text.split()).lower().split(" ") if text.split() else []
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def aligned(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def plain_classes(items):
    """doc_id to the smallest doc_id of its class."""
    texts = {i: labelled_kmers(t or "") for i, t in items}
    of = {i: i for i, _ in items}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(of)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = texts[i], texts[j]
            if a == b:
                same = True
            else:
                short, total = min(len(a), len(b)), len(a) + len(b)
                same = short >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) * 1.8 >= 0.8 * total - 1e-9
                same = same and aligned(a, b) * 1.8 >= 0.8 * total - 1e-9
            if same:
                x, y = sorted((top(i), top(j)))
                of[y] = x
    return {i: top(i) for i in ids}


def near_corpus():
    r = random.Random(5)
    out = [(i, t) for i, t, *_ in rows()[:19] if len(t or "") < 20_000]
    base = prose(77, 150)
    for k in range(90):  # more than SMALL in a bucket
        out.append((1000 + k, edited(base, r.sample(range(2, 148), r.choice([1, 2, 3, 4, 5])))))
    passage = prose(78, 40)
    for k in range(60):  # a shared passage does not make a copy
        out.append((2000 + k, passage + " " + prose(100 + k, 60)))
    return out


def test_near_copies(spark, tmp_path):
    items = near_corpus()
    docs = frame(spark, [(i, t, "en", "s", 1, 1, 1, "x") for i, t in items])
    got = {r["doc_id"]: r["class_id"] for r in as_dicts(near_dedup.op3_near_dedup(spark, folder(tmp_path, spark, documents=docs)))}
    assert got == plain_classes(items)
    kept = as_dicts(near_dedup.representatives(docs))
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values())) and set(kept[0]) == set(docs.columns)


def test_near_copies_defined_rows(spark, tmp_path):
    got = as_dicts(near_dedup.op3_near_dedup(spark, folder(tmp_path, spark, documents=frame(spark))))
    assert len(got) == len(rows())
    base = [r for r in got if r["class_id"] == 0]
    assert {r["doc_id"] for r in base} == {0, 1, 2, 3, None} and all(r["class_rows"] == len(base) for r in base)
    assert {r["doc_id"] for r in got if r["class_id"] == 7} == {7, 8, 9, 10}
    kept = as_dicts(near_dedup.representatives(frame(spark)))
    assert Counter(r["doc_id"] for r in kept)[0] == 1 and sum(r["doc_id"] is None for r in kept) == 1


def test_alignment_minds_order():
    a, b = prose(1, 120).split(), prose(2, 120).split()
    one, two = near_dedup.kmers([" ".join(a + b)])[0], near_dedup.kmers([" ".join(b + a)])[0]
    assert len(set(one.tolist()) & set(two.tolist())) > 0.9 * len(one)
    assert near_dedup.similarity(one, two) == 0 and near_dedup.similarity(one, one) == 1


# ---- chat ----

TURNS = "conv_id bigint, turn bigint, role string, text string, extra string"


def conversations():
    first = "shared \\ first [INST] turn <|x|> <<SYS>>"
    out = []
    for c in range(60):
        out += [(c, 0, "system", first), (c, 1, "user", f"question {c % 7}"), (c, 2, "assistant", f"answer </s> {c % 7} \\\\ {c % 2}")]
        out += [(c, 3, "user", "again"), (c, 4, "assistant", f"end {c}" * (c % 3))]
    out += [(100, 0, None, None), (100, 0, "tool\n|>", "x"), (100, 0, "tool\n|>", "x"), (None, 1, "user", "no id")]
    out += [(200, t, ["user", "assistant"][t % 2], "long " * 50) for t in range(400)]
    return [(*r, "e") for r in out]


def plain_chat(turns):
    by = {}
    for c, t, role, text, _ in turns:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, said in by.items():
        said.sort()
        loss = "".join(x for _, role, x in said if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in said)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield c, len(said), digest(whole), len(loss), digest(loss)


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(conversations(), TURNS)
    trees = chat.format_trees(turns, most=2_000)
    got = {tuple(r)[:5] for r in chat.read_trees(trees).collect()}
    assert got == set(plain_chat(conversations()))
    rows_ = as_dicts(trees)
    assert sum(len(r["text"]) for r in rows_) < sum(r["formatted_chars"] for r in as_dicts(chat.read_trees(trees)))
    for tree in rows_:
        for n in tree["nodes"]:
            above, at = [], n["parent"]
            while at >= 0:
                above.append((tree["nodes"][at]["start"], tree["nodes"][at]["end"]))
                at = tree["nodes"][at]["parent"]
            covered = {x for a, b in n["attends"] for x in range(a, b)}
            assert covered == {x for a, b in above for x in range(a, b)} and n["position"] == len(covered)


@pytest.mark.parametrize("shared", [100, 20_000, 200_000])
def test_long_shared_turns_are_merged(spark, shared):
    rows_ = [(c, t, *x, "") for c in range(50) for t, x in enumerate([("system", "s" * shared), ("user", f"question {c}")])]
    turns = spark.createDataFrame(rows_, TURNS).coalesce(1)
    trees = as_dicts(chat.format_trees(turns))
    assert len(trees) <= 8  # one a task at most, and no cut inside one
    assert sum(len(t["text"]) for t in trees) < len(trees) * (shared + 50) + 50 * 50
    # The same turns under a small bound: cuts at most double the text of the whole tree.
    small = as_dicts(chat.format_trees(turns, most=100))
    assert sum(len(t["text"]) for t in small) < 2 * (len(trees) * (shared + 50) + 50 * 50)
    assert {tuple(r)[:5] for r in chat.read_trees(chat.format_trees(turns, most=100)).collect()} == set(plain_chat(rows_))


def test_many_members_of_one_path_and_different_long_conversations():
    tree, said = chat.Tree(), [("user", "x" * 100)]
    rendered = [chat.render(*t) for t in said]
    members = 0
    while not tree.full(tree.shared(said), rendered, 1_600):
        tree.add(members, said, rendered)
        members += 1
    assert members == 101 and tree.size == len(rendered[0][0])  # the list of members is bounded too
    tree = chat.Tree()
    tree.add(0, said, rendered)
    other = [("user", "y" * 5_000)]
    assert tree.full(tree.shared(other), [chat.render(*t) for t in other], 1_600)


def test_large_ids_next_to_null(spark):
    big = 2**53 + 1
    rows_ = [(c, 0, "user", "same", "") for c in (big, None, -big, 7)]
    turns = spark.createDataFrame(rows_, TURNS).coalesce(1)
    trees = chat.format_trees(turns)
    assert {m["conv_id"] for t in as_dicts(trees) for m in t["members"]} == {big, None, -big, 7}
    assert {r["conv_id"] for r in chat.read_trees(trees).collect()} == {big, None, -big, 7}


def test_long_conversation_in_linear_time(spark):
    rows_ = [(1, t, ["user", "assistant"][t % 2], f"turn {t}", "") for t in range(20_000)]
    got = chat.read_trees(chat.format_trees(spark.createDataFrame(rows_, TURNS))).collect()
    assert [tuple(r)[:5] for r in got] == list(plain_chat(rows_))


def test_chat_query(spark, tmp_path):
    turns = spark.createDataFrame(conversations(), TURNS)
    got = {r[0]: tuple(r)[1:5] for r in chat.op4_chat_format(spark, folder(tmp_path, spark, conversations=turns)).collect()}
    want = {c: tuple(x) for c, *x in plain_chat([*conversations(), *[(-1, t, r, chat.TRAP, "") for t, r in ((0, "user"), (1, "assistant"))]])}
    assert got == want


@pytest.mark.parametrize("text", ["", "\\", "<s>", "</s></s>", "\\<s>", "[INST][/INST]", "<<SYS>><</SYS>>", "<|>", "<\\s>", "a\\\\b"])
def test_escapes(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    assert chat.parse(chat.render("user", text)[0]) == ("user", text)
    assert chat.parse(chat.render(f"r{text}", text)[0]) == (f"r{text}", text)


# ---- benchmark ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination(spark, tmp_path):
    item, short = prose(900, 40), "Ünique SHORT item x"
    items = [(1, item), (2, short), (10, item), (3, None), (4, "..."), (None, prose(901, 20)), (5, "Word")]
    some = rows() + [
        (500, prose(7, 30) + "\n" + " ".join(item.split()[3:20]).upper().replace("É", "é") + " tail", "", "", 1, 1, 1, ""),
        (501, "ünique short ITEM x " * 2 + prose(8, 400), "", "", 1, 1, 1, ""),
        (502, prose(901, 20) + " " + item, "", "", 1, 1, 1, ""),
    ]
    docs = frame(spark, some)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    path = folder(tmp_path, spark, documents=docs, benchmark=bench)
    want = Counter()
    for doc_id, text, *_ in some:
        w = item_words(text)
        hit, found = set(), set()
        for item_id, t in items:
            x = item_words(t)
            size = min(13, len(x))
            for k in range(len(x) - size + 1 if x else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == x[k : k + size]:
                        hit |= set(range(i, i + size))
                        found |= {str(item_id)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[(doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter(tuple(r) for r in decontaminate.op6_decontaminate(spark, path).collect()) == want
    for r in as_dicts(decontaminate.scan(docs, bench).where("size(spans) > 0")):
        marked = [x for a, b in r["spans"] for x in item_words(r["text"][a:b])]
        assert marked == [item_words(r["text"])[i] for i in r["hit_words"]]
    blocks = decontaminate.judged(docs, bench) , decontaminate.scan(docs, bench, most=50)
    names = ["doc_id", "n_words", "hit_words", "items"]
    assert sorted(map(repr, blocks[0].select(names).collect())) == sorted(map(repr, blocks[1].select(names).collect()))


# ---- toxicity ----


def toxic_corpus():
    r = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = prose(5000 + i, r.randint(30, 120)).split(" ")
        bad = i % 6 == 0
        for _ in range(r.randint(2, 4) if bad else 0):
            words[r.randrange(len(words))] = r.choice(["zworthless", "zscumbag", "zvile" + r.choice(["on", "er", "ti"])])
        docs.append((i, " ".join(words), "en", "s", 1, 1, 1, "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, tmp_path):
    docs, labels = toxic_corpus()
    odd = [(9000 + k, *r[1:]) for k, r in enumerate(rows())]
    label_rows = labels + [(9000, 1, None), (None, 1, 1), (0, 1, 0)]
    path = folder(
        tmp_path,
        spark,
        documents=frame(spark, docs + odd),
        labels=spark.createDataFrame(label_rows, "doc_id bigint, quality int, toxic int"),
    )
    got = {r["doc_id"]: r for r in as_dicts(toxicity.op7_toxicity(spark, path))}
    assert len(got) == len(docs + odd)
    test = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(test)) for i, *_ in labels)
    right = [got[i]["predicted"] == int(i % 6 == 0) for i in test]
    assert np.mean(right) > 0.97
    text = dict((d[0], d[1]) for d in docs)
    for i in test:
        if i % 6 == 0 and got[i]["predicted"]:
            assert any(text[i][a:b].startswith("z") for a, b in got[i]["spans"])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[9007]["score"] == 0.0


def test_toxicity_without_labels(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = folder(tmp_path, spark, documents=frame(spark), labels=none)
    assert {r["score"] for r in as_dicts(toxicity.op7_toxicity(spark, path))} == {0.0}


def test_chain_sums_over_all_paths():
    odds, move = np.array([0.3, -1.0, 2.0, 0.5, -0.2]), np.array([[0.2, -1.0], [0.4, 0.9]])
    lengths = [3, 2]
    got = toxicity.Chain(np.array(lengths)).marginals(odds, move)
    begin = 0
    for n in lengths:
        e, total, one = odds[begin : begin + n], 0.0, np.zeros(n)
        for path in range(2**n):
            s = [(path >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[k] * s[k] for k in range(n)) + sum(move[s[k], s[k + 1]] for k in range(n - 1)))
            total += w
            one += w * np.array(s)
        assert np.allclose(got[begin : begin + n], one / total)
        begin += n


# ---- tokens ----


def test_token_counts(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    r = random.Random(1)
    letters = "ab  eé\n▁tTh nAl1.,中日🙂\x00<s>/]"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(300)]
    odd += [" " * n + "x" for n in range(40)] + ["=" * 3000, "the" * 4000, " " * 5000]
    some = rows() + [(1000 + i, t, "", "", 1, 1, 1, "") for i, t in enumerate(odd)]
    got = token_counts.op9_token_counts(spark, folder(tmp_path, spark, documents=frame(spark, some))).collect()
    want = Counter()
    for doc_id, text, *_ in some:
        n = len(library.encode(text or ""))
        want[(doc_id, len((text or "").encode()), n, n > 4096)] += 1
    assert Counter(tuple(x) for x in got) == want


# ---- archives ----

PAGES = [
    (5, "http://a/\r\nX: y", "<p>same</p>", "e"),
    (3, None, "<p>same</p>", "e"),
    (9, "http://b", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, "e"),
    (1, "http://c", None, "e"),
    (2, "http://c", "", "e"),
    (7, "http://ü", "ünï 🙂\n" * 500, "e"),
    (None, "http://d", "<p>same</p>", "e"),
    (3, None, "<p>same</p>", "e"),
]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, digest string")
    got = Counter(tuple(r) for r in warc.op10_warc(spark, folder(tmp_path, spark, pages=pages)).collect())
    import base64

    want = Counter()
    for page_id, _, html, _ in PAGES:
        data = (html or "").encode()
        first = min(p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(page_id, len(data), digest, "response" if page_id == first else "revisit", None if page_id == first else first)] += 1
    assert got == want


def test_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", prose(i, 40), "") for i in range(30)], "page_id bigint, url string, html string, e string")
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part*"))
    whole = list(warc.salvage(data))
    assert [x["kind"] for x in whole] == ["record"] * 30
    bad = bytearray(data)
    bad[whole[4]["offset"] + whole[4]["length"] - 20] ^= 1
    cut = bytes(bad[: whole[10]["offset"] + 50]) + b"garbage" + bytes(bad[whole[12]["offset"] :])
    found = list(warc.salvage(cut))
    assert [x["page_id"] for x in found if x["kind"] == "record"] == [whole[i]["page_id"] for i in range(30) if i not in (4, 10, 11)]
    gaps = [x for x in found if x["kind"] == "gap"]
    assert len(gaps) == 2 and gaps[0]["offset"] == whole[4]["offset"] and gaps[0]["length"] == whole[4]["length"]
    assert sum(x["length"] for x in found) == len(cut)
    members = [gzip.compress(data[x["offset"] : x["offset"] + x["length"]]) for x in whole]
    broken = b"".join(members[:3]) + members[3][:-30] + b"".join(members[4:])
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.warc.gz").write_bytes(broken)
    kinds = Counter(r["kind"] for r in warc.read_archives(spark, f"{tmp_path}/z").collect())
    assert kinds == {"record": 29, "gap": 1}


@pytest.mark.parametrize(
    "make,table",
    [
        (near_dedup.op3_near_dedup, "documents"),
        (decontaminate.op6_decontaminate, "documents"),
        (toxicity.op7_toxicity, "documents"),
        (token_counts.op9_token_counts, "documents"),
    ],
)
def test_empty_documents(spark, tmp_path, make, table):
    path = folder(
        tmp_path,
        spark,
        documents=spark.createDataFrame([], SCHEMA),
        benchmark=spark.createDataFrame([], "item_id bigint, text string"),
        labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
    )
    assert make(spark, path).count() == 0


def test_empty_pages_and_conversations(spark, tmp_path):
    path = folder(
        tmp_path,
        spark,
        pages=spark.createDataFrame([], "page_id bigint, url string, html string"),
        conversations=spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"),
    )
    assert warc.op10_warc(spark, path).count() == 0
    assert [r["conv_id"] for r in chat.op4_chat_format(spark, path).collect()] == [-1]
