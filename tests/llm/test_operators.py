import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import containers, encoding, formatting, groups, leaks, lookalike, mixing, personal, spans

TEXTS = "source_id string, text string, stored_a string, canonical string, look string"


def frame(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(a, b, "x", None, "y") for a, b in rows], TEXTS)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_fold():
    same = ["file Ａ1é", "ﬁle Α１é", "fi​le A1é", "fіlе　A1é"]
    assert len({lookalike.fold(x) for x in same}) == 1
    for a, b in (("x²", "x2"), ("é", "e"), ("a", "A"), ("，", ","), ("a b", "a  b"), ("a b", "a\tb"), ("a b", "a\nb"), ("0", "O")):
        assert lookalike.fold(a) != lookalike.fold(b)
    assert lookalike.fold(None) is None and lookalike.fold("") == ""
    assert all(lookalike.fold(v) == v for v in lookalike.mapping().values())


def test_look_alike_pairs(spark):
    a = frame(spark, [("a", "word one"), ("b", "wоrd one"), ("c", "word one"), ("d", "Word one"), ("e", None), ("f", ""), ("g", "​"), ("h", "…"), ("a", "word one"), (None, "word one")])
    b = frame(spark, [("z", "word one"), ("y", "wórd one")])
    assert rows(lookalike.look_alike_pairs(a, b)) == {("a", "b"), ("b", "c"), ("a", "z"), ("b", "z"), ("c", "z")}
    assert lookalike.look_alike_pairs(a.limit(0), b.limit(0)).count() == 0


def test_the_collation_decides(spark):
    a = frame(spark, [("a", "wo\u200brd é"), ("b", "word e\u0301"), ("c", "wоrd\u00a0e\u0301\ufeff"), ("d", "word e"), ("e", "word-é")])
    assert rows(lookalike.look_alike_pairs(a)) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert rows(lookalike.look_alike_pairs(a, collated=False)) == set()
    assert {(r.canonical_source_id, r.source_id) for r in lookalike.look_alike_members(a).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    texts = dict(rows(lookalike.consistent_texts(frame(spark, [("a", "wo\u200brd é"), ("b", "word e\u0301"), ("n", None), ("z", ""), ("p", "…")]))))
    assert texts == {"a": "word é", "b": "word é", "n": None, "z": "", "p": "…"}


def test_the_collation_passes_over_what_shows_nothing(spark):
    unseen = [k for k, v in lookalike.mapping().items() if v == "" and k not in lookalike.FILLERS]
    df = spark.createDataFrame([(k,) for k in unseen], "c string").selectExpr("concat('a', c, 'b') COLLATE UNICODE = 'ab' AS same")
    assert len(unseen) > 400 and df.where("NOT same").count() == 0


@pytest.mark.parametrize("left,right", [lookalike.COPTIC, lookalike.CHEROKEE, lookalike.LISU, lookalike.LATIN])
def test_published_confusables(spark, left, right):
    skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    assert [skeleton(a) for a in left] == [skeleton(b) for b in right]


def test_groups(spark):
    rng = random.Random(3)
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}", True) for i in range(60)] + [("hub", f"h{i}", True) for i in range(40)] + [("p", "q", False), ("p", "q", None), ("r", "r", True), ("s", None, True), (None, None, True)]
    pairs += [(f"x{rng.randrange(60)}", f"x{rng.randrange(60)}", True) for _ in range(40)]
    got = rows(groups.group_identifiers(spark.createDataFrame(pairs, "left_source_id string, right_source_id string, is_duplicate boolean")))
    near = defaultdict(set)
    for a, b, y in pairs:
        for v in (a, b):
            near[v] |= {v}
        if y and a and b:
            near[a].add(b)
            near[b].add(a)
    want = set()
    for v in near:
        if v:
            seen, todo = set(), [v]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
            want.add((min(x for x in seen if x), v))
    assert got == want
    assert groups.group_identifiers(spark.createDataFrame([], "left_source_id string, right_source_id string, is_duplicate boolean")).count() == 0


def test_copies(spark):
    t = frame(spark, [("a", "Hello, World 1"), ("b", "hello world1"), ("c", "hello world 2"), ("d", '{"x": 1, "y": ["a", "b"]}'), ("e", "Y: a, b\nX: 1"), ("f", "x=b; y=a 1"), ("g", "y=1; x=a b"), ("h", None), ("i", ""), ("j", "..."), ("k", "Нello wоrld 1"), ("a", "Hello, World 1")])
    assert rows(formatting.copies(t)) == {("a", "b"), ("a", "k"), ("d", "e")}
    assert rows(formatting.copy_counts(t)) == {("a", 3), ("c", 1), ("d", 2), ("f", 1), ("g", 1), ("h", 1), ("i", 1), ("j", 1)} - {("h", 1)}
    assert formatting.copies(t.limit(0)).count() == 0


def test_copies_with_colliding_sums(spark):
    t = frame(spark, [(f"{k}{i}", v) for i in range(3) for k, v in {"a": "one", "b": "two", "c": "x: 1\ny: 2", "d": "x: 2\ny: 1", "e": "x: 1\nx: 1\ny: 2"}.items()] + [("f", "ONE!"), ("g", "y=2; X=1")])
    weak = lambda form: bytes(15) + bytes([len(form) % 2])
    want = {(f"{k}0", f"{k}{i}") for k in "abcde" for i in (1, 2)} | {("a0", "f"), ("c0", "g")}
    assert rows(formatting.copies(t)) == want == rows(formatting.copies(t, weak))


def test_fill():
    rng = random.Random(1)
    lengths = [rng.choice([rng.randint(0, 60), rng.randint(60, 700), rng.randint(700, 2048)]) for _ in range(4000)]
    place = containers.fill(lengths)
    used = defaultdict(int)
    for n, p in zip(lengths, place, strict=True):
        used[p] += n
    assert max(used.values()) <= 2048 and len(used) <= 1.02 * -(-sum(lengths) // 2048) + 2


def _best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("n", [1, 5, 64, 65, 400])
def test_configurations_against_best_fit(n):
    rng = random.Random(n)
    lengths = [rng.randint(690, 1020) for _ in range(n)]
    assert containers.fill(lengths).max() + 1 <= _best_fit(lengths, 2048) + 1


def test_pack(spark):
    got = containers.pack(frame(spark, [("a", "x" * 25), ("b", "y" * 5), ("c", None), ("d", ""), ("a", "x" * 25), ("e", "z" * 20)]), capacity=10).collect()
    assert sorted((r.source_id, r.piece, r.n_chars) for r in got) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 5), ("c", 0, 0), ("d", 0, 0), ("e", 0, 10), ("e", 1, 10)]
    assert len({r.sequence_id for r in got}) == 5 and all(r.unused == 0 for r in got)


ITEM = "The quick brown fox jumps over the lazy dog and then some more words follow here"


@pytest.mark.parametrize("block", [100_000, 40])
def test_leaks(spark, block):
    corpus = frame(spark, [("full", "before " + ITEM.upper() + " after"), ("part", "zz " + ITEM[10:70] + " zz"), ("less", ITEM[:38]), ("short", "say: abc 12!"), ("edit", ITEM.replace("lazy", "lazi")), ("none", None), ("empty", ""), ("two", "a"), ("two", "z" + ITEM)])
    items = frame(spark, [("e1", ITEM), ("e2", "Abc12"), ("e3", None), ("e4", "?!"), ("e1", ITEM), ("e5", "no match at all in here"), ("e5", "brown fox jumps over")])
    exact = rows(leaks.leaks(corpus, items, block_signatures=block).select("eval_source_id", "source_id"))
    assert exact == {("e1", "full"), ("e1", "part"), ("e2", "short"), ("e1", "two"), ("e5", "full"), ("e5", "part"), ("e5", "two"), ("e5", "edit"), ("e5", "less")}
    if block == 100_000:
        edits = {(a, b): e for a, b, e in rows(leaks.leaks(corpus, items, max_edits=2))}
        assert {k for k, e in edits.items() if e == 0} == exact and edits["e1", "edit"] in (0, 1)
    assert leaks.leaks(corpus.limit(0), items).count() == 0 and leaks.leaks(corpus, items.limit(0)).count() == 0


def test_long_item_is_segmented(monkeypatch):
    monkeypatch.setattr(leaks, "SEGMENT", 50)
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefgh") for _ in range(333))
    pieces = list(leaks._segments(item, 40))
    assert all(any(item[i : i + 40] in p for p in pieces) for i in range(len(item) - 39)) and max(map(len, pieces)) <= 50


@pytest.mark.parametrize("length,edits", [(40, 2), (20, 1), (30, 1)])
def test_recall_of_planted_edits(spark, length, edits):
    """150 runs with edits at random places: at least nine in ten are found, with no more edits than were made."""
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(n))
    items, corpus = [], []
    for k in range(150):
        item = word(length if length < 40 else rng.choice((40, 80, 300)))
        lo = rng.randrange(len(item) - min(40, len(item)) + 1)
        run = list(item[lo : lo + 40])
        for at in rng.sample(range(1, len(run) - 1), edits):
            run[at] = rng.choice(("#", run[at] + "9", "7")).replace("#", "")
        items.append((f"e{k}", item))
        corpus.append((f"c{k}", word(rng.randrange(300)) + "".join(run) + word(rng.randrange(300))))
    found = {(a, b): e for a, b, e in rows(leaks.leaks(frame(spark, corpus), frame(spark, items), max_edits=2))}
    hit = [k for k in range(150) if found.get((f"e{k}", f"c{k}"), 9) <= edits]
    assert len(hit) >= 135 and all(a[1:] == b[1:] for a, b in found)


def test_unreachable_recall_is_refused():
    with pytest.raises(ValueError, match="repetitions"):
        leaks.plan_for(6, 2, run=6)


def test_least_edits():
    assert leaks.least_edits("kitten", "a sitten b", 2) == 1
    assert leaks.least_edits("abc", "zzz", 1) == 2
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a):
            new = [i + 1]
            for j, x in enumerate(b):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        assert leaks.least_edits(a, b, 999) == min(row)


def test_tree_encoding_round_trip(spark):
    import public_tokenizers

    small = encoding.TreeEncoder(encoding.public_ranks(), public_tokenizers.PATTERN, leaf=8, window=2)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "it's ", "  ", "\n", "中文", "12", "é", "'re", "🙂", "x", "!?", "<|endoftext|>"]) for _ in range(rng.randint(0, 90))) for _ in range(200)] + [" " * 300, "a" * 300, "好" * 300]
    for t in texts:
        assert small.encode(t) == small.own.encode_ordinary(t) and small.decode(small.encode(t)) == t
    got = {r.doc_id: list(r.ids) for r in encoding.encode(spark.createDataFrame([(1, "hello", "z"), (2, "", "z"), (3, None, "z")], "doc_id long, text string, ids string")).collect()}
    assert got == {1: small.own.encode_ordinary("hello"), 2: [], 3: []}


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "a" if i < 300 else "b" if i < 330 else None if i < 340 else "c") for i in range(400)] + [(500, None, "a"), (501, "", "b")], "doc_id long, text string, source string").withColumn("n_tokens", F.lit(0)).withColumn("part", F.lit("x"))
    spec = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4), ("b", 0.5, 4), ("gone", 0.2, 3), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    mixed = mixing.mixture(docs, spec)
    by = {r.source: r for r in mixing.shares(mixed, spec).collect()}
    assert by["b"].most_uses == 4 and abs(by["a"].share - 0.5) < 0.02 and by["gone"].n_tokens == 0 and "c" not in by
    assert mixing.mixture(docs.limit(0), spec).count() == 0


@pytest.mark.parametrize("cold", [64, 1])
def test_shared_spans(spark, monkeypatch, cold):
    monkeypatch.setattr(spans, "COLD_PLACES", cold)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh 中") for _ in range(n))
    p, q, foot = word(260), word(199), word(120)
    docs = {1: word(300) + p + foot, 2: p + word(50) + foot, 3: word(10) + "1" + q + "1" + word(400), 4: word(77) + "2" + q + "2" + foot, 5: None, 6: "", 7: p[:200] + "!", 8: word(500), 9: "x" * 450, 10: "y" + "x" * 220}
    own = defaultdict(set)
    for k, t in docs.items():
        for i in range(len(t or "") - 199):
            own[t[i : i + 200]].add(k)
    want = {(a, b) for v in own.values() for a in v for b in v if a < b}
    df = spark.createDataFrame([(k, t, "z") for k, t in docs.items()], "doc_id long, text string, link string")
    assert rows(spans.shared_pairs(df)) == want and (1, 7) in want and (3, 4) not in want
    cover = {k: sum(any(len(own[t[j : j + 200]]) > 1 for j in range(max(0, i - 199), min(i, len(t) - 200) + 1)) for i in range(len(t or ""))) for k, t in docs.items()}
    assert {r.doc_id: r.shared_chars for r in spans.shared_amounts(df).collect()} == cover
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_hot_passages(spark):
    """A passage in over 64 documents, a shorter footer in all of them, and periodic text: the hot anchors' way, with no setting changed."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh 中") for _ in range(n))
    p, foot = word(230), word(150)
    docs = {k: word(rng.randint(0, 90)) + (p if k < 70 else "") + word(30) + foot for k in range(90)} | {90: "ab" * 400, 91: word(20) + "ab" * 150, 92: "ba" * 99}
    own = defaultdict(set)
    for k, text in docs.items():
        for i in range(len(text) - 199):
            own[text[i : i + 200]].add(k)
    want = {(a, b) for v in own.values() for a in v for b in v if a < b}
    df = spark.createDataFrame([(k, x) for k, x in docs.items()], "doc_id long, text string")
    assert rows(spans.shared_pairs(df)) == want and (0, 69) in want and (90, 91) in want and (70, 71) not in want
    cover = {k: sum(any(len(own[x[j : j + 200]]) > 1 for j in range(max(0, i - 199), min(i, len(x) - 200) + 1)) for i in range(len(x))) for k, x in docs.items()}
    assert {r.doc_id: r.shared_chars for r in spans.shared_amounts(df).collect()} == cover


def test_anchors_depend_on_the_span_alone(monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    for shared in (word(200), "x" * 200, "abc" * 70, "ab" * 60 + word(100)):
        alone = set(spans.anchors([shared], 200, 100)[2].tolist())
        for n in (0, 1, 5000):
            beside = spans.anchors([word(n + 300), word(n) + shared + word(7)], 200, 100)
            assert alone & set(beside[2].tolist())
    assert len(spans.anchors(["x" * 5000], 200, 100)[0]) < 60
    monkeypatch.setattr(spans, "PIECE", 500)
    whole = "".join(word(3000))
    pieces = [(b, t) for _, begins, texts in spans._chunks([1], [whole], 200) for b, t in zip(begins, texts, strict=True)]
    assert all(any(b <= i and i + 200 <= b + len(t) for b, t in pieces) for i in range(len(whole) - 199))


def test_decoding_in_pieces_is_the_whole_viterbi():
    model, rng = personal.load(personal.WEIGHTS.read_bytes()), np.random.default_rng(3)
    scores = [(rng.standard_normal((n, 11)) * 2 + np.where(rng.random((n, 1)) < 0.9, 9, 0) * (np.arange(11) == 0)).astype(np.float32) for n in (1, 2, 40, 300, 1000)]
    for own, whole in zip(model.decode(scores), model._paths(scores, [True] * 5, [True] * 5), strict=True):
        assert (own == whole).all()


def test_personal(spark):
    t = frame(spark, [("a", "Write to anna.smith@corp.example.com before the next crawl."), ("b", "联系人：沈砚渡。值班电话：154-0000-1234，夜间有效。"), ("c", "The quick job used 1,540,352,378 tokens."), ("d", None), ("e", ""), ("f", "We saw 20 rows. " * 400 + "Signed, Dr. Pavrel Venholt")])
    got = rows(personal.found_types(t))
    assert {("a", "email"), ("b", "person_name"), ("b", "phone"), ("f", "person_name")} <= got and not [x for x in got if x[0] in "cde"]
    texts = dict(map(tuple, personal.redacted(t).collect()))
    assert texts["a"] == "Write to [EMAIL] before the next crawl." and texts["d"] is None and texts["e"] == ""
