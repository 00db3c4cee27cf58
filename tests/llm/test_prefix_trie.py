import hashlib
import random
import zlib

from millrace.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], x))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def under(k):
        stack = [k]
        while stack:
            yield (k := stack.pop())
            stack += children.get(k, [])

    out = []
    for k, m in members.items():
        below = list(under(k))
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), sum(u not in children for u in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as pos", "3 as conv")
    return sorted((tuple(r) for r in prefix_trie.shared_prefix_trie(df).select(*COLUMNS).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 311, 400, 499]:
        for t in range(rng.choice([1, 2, 3, 4, 9, 30 if c == 7 else 5])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé😀", "ccc"])))
    rows += [(7, None, None, "first"), (7, None, "user", None), (8, 1, "user", "a"), (8, 1, "user", "a"), (None, 1, "user", "x"), (700, 0, None, None)]
    rng.shuffle(rows)
    assert told(spark, rows) == by_hand(rows)


def test_one_prefix_shared_by_all_and_a_deep_path(spark):
    rows = [(c, t, "user", "same") for c in range(300, 360) for t in range(6)]
    rows += [(1000, t, "user", "deep") for t in range(150)]
    assert told(spark, rows) == by_hand(rows)


def test_conversations_without_turns_of_their_own_end_at_the_root(spark):
    # The first turns go, and there is no first conversation of the group to take them from.
    rows = [(c, 0, "user", "gone") for c in range(501, 521)]
    said = by_hand(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in said)
    assert told(spark, rows) == said


def test_empty_table(spark):
    assert told(spark, []) == []


def test_levels_of_light_paths(spark):
    """A caterpillar of pairs: every node has two children, so light paths hang on light paths."""
    rows = []
    for c in range(64):
        for t in range(6):
            rows.append((100 * c, t, "user", str(c >> (5 - t) & 1)))
    assert told(spark, rows) == by_hand(rows)


def test_as_they_are(spark):
    rows = [(1, 0, "user", "ab"), (2, 0, "user", "ab"), (2, 1, "user", "c")]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    out = prefix_trie.prefix_trie(prefix_trie.conversations_as_they_are(turns)).select("depth", "n_convs", "saved_tokens").collect()
    assert sorted(tuple(r) for r in out) == [(0, 2, 2), (1, 2, 2), (2, 1, 0)]
