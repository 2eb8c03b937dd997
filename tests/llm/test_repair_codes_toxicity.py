"""Conversation repair, vector codes and toxicity against brute force: nulls, empty and long texts, ties, repeated rows, clashing names."""

import collections
import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from tabscope.llm import conversations, toxicity, vector_codes

TURNS = "conv_id long, turn long, role string, text string, k long, _g string"
BLANKS = " \t\n\x0b\x0c\r"


def repaired_plainly(rows):
    """Every result column of one conversation, by a shortest path over (row, state) with (cost, audit) as length."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        fault = "blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANKS)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    reads = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, audit, lines
        steps = [(3, "I", i, role, (role, "")) for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                steps += [(more, "K", i + 1, role, (role, text))] + [(3 + more, "R", i + 1, r, (r, text)) for r in ("user", "assistant")]
        for price, letter, after, role, line in steps:
            if (state, role[:1]) in reads and (letter == "K" or role[:1] != "s"):
                heapq.heappush(heap, (cost + price, audit + letter, after, reads[state, role[:1]], (*lines, line)))
    cost, audit, lines = min(done[len(rows), s] for s in ("", "a") if (len(rows), s) in done)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    count = collections.Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations_of(draw, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append((conv, draw.choice([turn, turn, turn + 1, None]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                         draw.choice(["Hello there.", "Yes!", "cut off", "", " \t", None, "why? ", "x" * 5000 + "."]), 7, "g"))
    return rows + rows[:5]


@pytest.mark.parametrize("span", [1024, 2])
def test_repair(spark, span):
    rows = conversations_of(random.Random(5), 40)
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.", 7, "g") for t in range(400)]  # in many spans and tasks
    summary, lines = conversations.repaired(spark.createDataFrame(rows, TURNS).repartition(5), span=span)
    got = {r[0]: tuple(r[1:]) for r in summary.collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: repaired_plainly(group) for conv, group in groups.items()}
    texts = collections.defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: r.place):
        texts[r.conv_id] += [f"{z.role}:{z.text}" for z in r.lines]
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: g[7] for c, g in got.items()}


def test_damage_and_absent_rows(spark):
    rows = [(c, t, "assistant", "One. Two!", 7, "g") for c in range(30) for t in range(4)] + [(None, None, None, None, 7, "g")]
    out = conversations.damaged(spark.createDataFrame(rows, TURNS))
    kinds = {(r.conv_id, r.turn): (r.absent, r.role, r.text) for r in out.collect()}
    for conv, turn, role, text, *_ in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = role or " ", text or " "
        want = {1: (role, ""), 2: (role, text.translate({ord(c): None for c in ".!?"})), 4: ("user", text)}.get(kind, (role, text))
        assert kinds[conv, turn] == (kind == 0, *want)
    dropped = spark.createDataFrame([(1, 0, "user", "a.", True)], "conv_id long, turn long, role string, text string, absent boolean")
    assert [tuple(r) for r in conversations.repaired(dropped, absent="absent")[0].collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_nothing(spark):
    summary, lines = conversations.repaired(spark.createDataFrame([], TURNS))
    assert summary.count() == lines.count() == 0


def codes_plainly(vectors, parts, entries, rounds):
    """Codes, errors and codebooks with every distance worked out in every round."""
    x = [[int(np.floor(1024 * float(z))) for z in v] for _, v in vectors]
    size = -(-max(map(len, x)) // parts)
    x = np.array([v + [0] * (parts * size - len(v)) for v in x], object)
    order = sorted(range(len(x)), key=lambda i: ((vectors[i][0] is None, vectors[i][0] or 0)))
    books, codes, errors = [], [], np.zeros(len(x), object)
    for p in range(parts):
        piece = x[:, p * size:(p + 1) * size]
        book = piece[order[:entries]].copy()

        def nearest():
            d = np.array([[((a - b) ** 2).sum() for b in book] for a in piece])
            return d.argmin(axis=1), d.min(axis=1)

        for _ in range(rounds):
            near, _ = nearest()
            for j in range(len(book)):
                if (near == j).any():
                    book[j] = [sum(column) // int((near == j).sum()) for column in piece[near == j].T]
        near, d = nearest()
        codes.append(near)
        errors = errors + d
        books.append(book)
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], errors.tolist(), np.array(books)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9])
@pytest.mark.parametrize("closest", [16, 1])
def test_codes(spark, scale, closest):
    draw = np.random.default_rng(3)
    vectors = [(i, (draw.normal(size=12).round(1) * scale).tolist()) for i in range(300)]
    vectors += [(300, vectors[0][1]), (301, vectors[1][1]), (302, [0.5] * 5), (303, [-1.0] * 12)]  # ties, repeats, a short one
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")] * 12)]
    rows = [(i, v, i % 3 if i % 5 else None, 1, 2) for i, v in vectors + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int, v int").repartition(3)
    coded, books, _ = vector_codes.compressed(df, entries=20, rounds=4, closest=closest)
    codes, errors, want = codes_plainly(vectors, 4, 20, 4)
    got = {r.vec_id: r for r in vector_codes.with_label_errors(coded).collect()}
    assert books.tolist() == want.tolist() and len(got) == len(vectors)
    assert all((got[i].code, got[i].error) == (c, min(e, 2**63 - 1)) for (i, _), c, e in zip(vectors, codes, errors))
    sums = collections.Counter()
    for i, r in got.items():
        sums[r.label] += r.error
    assert all(r.label_error == min(sums[r.label], 2**63 - 1) for r in got.values())


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    empty, books, _ = vector_codes.compressed(spark.createDataFrame([(1, None, 1)], kind))
    assert vector_codes.with_label_errors(empty).count() == 0 and books.size == 0
    one = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], None)], kind)
    coded, books, _ = vector_codes.compressed(one)
    assert sorted((r.code, r.error) for r in coded.collect()) == [("00000000", 0)] * 2 and books.shape == (4, 2, 1)


def toxic_rows(draw, n):
    syllables = ["ba", "do", "ri", "men", "tas", "lo", "ve", "nu"]
    rows = []
    for i in range(n):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.choice([5, 40, 200]))]
        if toxic := i % 9 == 0:
            bad = draw.choice(["zumpf", "krottel", "idiot"])
            words[draw.randrange(len(words))] = bad if bad == "idiot" else bad + draw.choice(syllables)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_learns_stems_and_spares_long_texts(spark):
    draw = random.Random(2)
    rows = toxic_rows(draw, 900)
    long = " ".join(t for _, t, toxic in rows if not toxic)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (5002, long, "x"), (3, rows[3][1], "x")],
                                 "doc_id long, text string, _id string").repartition(4)
    labels = spark.createDataFrame([(i, int(toxic)) for i, _, toxic in rows if i % 5] + [(1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    wrong = [i for i, _, toxic in rows if (got[i] >= 0.5) != toxic]
    assert len(wrong) <= 3 and got[5000] == got[5001] < 0.5 and got[5002] < 0.5
    assert any(s.startswith("zump") for s in model.stems)
    with pytest.raises(ValueError):
        toxicity.scored(docs.withColumnRenamed("_id", "score"), model)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you are an idiot, a pathetic idiot!!!"), (2, "a fine day")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()}
    assert 0 <= scores[2] <= scores[1] <= 1
    assert toxicity.scored(docs.where("doc_id < 0"), toxicity.train(docs.where("doc_id < 0"), none)).count() == 0


def test_label_model_finds_accuracies_and_overlaps():
    """Votes drawn from known probabilities, two voters being one and the same: the class is found, the copy counts once."""
    draw = np.random.default_rng(1)
    n = 20_000
    y = draw.random(n) < 0.2
    right, wrong = np.array([0.9, 0.7, 0.8, 0.6]), np.array([0.05, 0.1, 0.02, 0.2])
    votes = draw.random((n, 4)) < np.where(y[:, None], right, wrong)
    votes = np.concatenate([votes, votes[:, 3:]], axis=1)
    masks = (votes * (1 << np.arange(5))).sum(axis=1)
    labelled = np.arange(n) < 1_000  # these tie the hidden class to the label, the others count by their votes
    model = toxicity.LabelModel.first(5, 0.1)
    for number in range(toxicity.ROUNDS):
        p = np.where(labelled, y, model.posterior(masks))
        weight = labelled if number == 0 else np.ones(n)
        pairs = np.stack([(votes * (w * weight)[:, None]).T @ votes for w in (1 - p, p)]).astype(float)
        model = toxicity.LabelModel.fitted(pairs, np.array([((1 - p) * weight).sum(), (p * weight).sum()]))
    assert abs(model.share - 0.2) < 0.03
    assert model.parent[3] == 4 or model.parent[4] == 3  # the copy depends on its original
    posterior = model.posterior(masks)
    assert np.mean((posterior >= 0.5) == y) > 0.95
    doubled = posterior[(masks & 7 == 0) & (masks >> 3 == 3)]  # only the doubled voter fires: it counts once
    assert len(doubled) and abs(doubled[0] - 0.2 * 0.1 * 0.3 * 0.2 * 0.6 / (0.2 * 0.1 * 0.3 * 0.2 * 0.6 + 0.8 * 0.95 * 0.9 * 0.98 * 0.2)) < 0.03
