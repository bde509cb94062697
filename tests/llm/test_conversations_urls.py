"""Chat formatting and URL filters against plain versions."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commentlens.llm import chat, url_filter

CONV = "conv_id long, turn long, role string, text string"
ODD_TEXT = st.text(alphabet=st.sampled_from(list("<|[]/\\sINSTSYS>\n é")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT, ODD_TEXT)
def test_turns_read_back(role, text):
    piece, start, end = chat.turn_text(role, text)
    assert chat.read_turn(piece) == (role, text)
    assert chat.unescape(piece[start:end]) == text
    inside = piece[len(chat.BEGIN) : -len(chat.END)]
    assert not any(c in inside for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def _want(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.turn_text(r, t)[0]) for _, _, r, t in turns))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = []
    for conv in range(300):
        for turn in range(draw.randint(1, 5)):
            said = f"hello </s> {draw.randint(0, 1 + turn)}" if draw.random() < 0.8 else f"\\<|turn|> {conv}"
            out.append((conv, turn, ["user", "assistant"][turn % 2], said))
    return out + [(1000, 0, None, None), (1000, None, "system", ""), (1001, 0, "user", "x"), (1001, 0, "user", "x"), (None, 1, "assistant", "y"), (1002, 0, "assistant", "é" * 50_000)]


def test_tree_of_conversations(spark, rows):
    df = spark.createDataFrame(rows, CONV).repartition(6)
    tree, members = chat.prefix_tree(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.conversation_digests(tree, members).collect()}
    assert got == _want(rows)
    nodes = sorted(tree.collect(), key=lambda n: n.start)
    at, starts = 0, {}
    for n in nodes:  # one sequence without gaps, each beginning once, ancestors first
        assert n.start == at and n.end - n.start == len(n.piece)
        at = n.end
        path = tuple(starts[a.start].piece for a in n.ancestors) + (n.piece,)
        assert n.position == sum(len(p) for p in path[:-1]) and n.depth == len(path) - 1
        assert path not in {p for p, _ in starts.items() if isinstance(p, tuple)}
        starts[n.start], starts[path] = n, n
    for a, b in zip(nodes, nodes[1:], strict=False):  # depth first: the next is a child, or hangs from an ancestor
        assert b.depth <= a.depth + 1
        assert {x.start for x in b.ancestors} <= {x.start for x in a.ancestors} | {a.start}


def test_tree_over_many_partitions(spark, rows):
    """Shared beginnings go on from one partition to the next."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree, members = chat.prefix_tree(spark.createDataFrame(rows, CONV))
        assert {r.conv_id: r.turns_sha256 for r in chat.conversation_digests(tree, members).collect()} == {k: v[1] for k, v in _want(rows).items()}
        nodes = sorted(tree.collect(), key=lambda n: n.start)
        assert [n.start for n in nodes] == [0, *[n.end for n in nodes[:-1]]]
        pieces = {n.start: n.piece for n in nodes}
        paths = [(*[pieces[a.start] for a in n.ancestors], n.piece) for n in nodes]
        assert len(set(paths)) == len(paths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tokens_of_a_tokenizer(spark, rows):
    tree, _ = chat.prefix_tree(spark.createDataFrame(rows[:30], CONV), tokenizer="/opt/tokenizers/byte_bpe_50k.json")
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    encoder.encode_special_tokens = True
    assert all(n.end - n.start == len(encoder.encode(n.piece, add_special_tokens=False).ids) for n in tree.collect())


def test_no_conversations(spark):
    tree, members = chat.prefix_tree(spark.createDataFrame([], CONV))
    assert tree.count() == 0 and chat.conversation_digests(tree, members).count() == 0


DAY = 86_400
ENTRIES = [
    ("a.example.com", 10 * DAY, True, "spam"), ("a.example.com", 20 * DAY, False, None), ("a.example.com", 500 * DAY, True, "again"),
    ("example.org", 0, True, "domain"), ("b.example.net/x", 5, True, "path"), ("b.example.net", 90 * DAY, True, "host"),
    ("tie.example.com", 7, False, "off"), ("tie.example.com", 7, True, "z"), ("tie.example.com", 7, True, "y"),
    (None, 1, True, "n"), ("c.example.com", None, True, "n"), ("c.example.com", 3, None, "n"), ("com", 0, True, "too wide"),
]


def test_captures(spark):
    urls = ["http://A.example.com./p?q", "https://u:p@deep.www.example.org:8080/", "http://b.example.net/x/y#z", "http://b.example.net/w", "http://tie.example.com", "http://c.example.com/", "not a url", "", None]
    rows = [(u, at, k, 1) for k, u in enumerate(urls) for at in (0, 5, 7, 10 * DAY, 20 * DAY - 1, 20 * DAY, 95 * DAY, 501 * DAY, None)]
    rows += rows[:3]
    captures = spark.createDataFrame(rows, "url string, fetched long, page_id long, blocked int")
    out = url_filter.filter_captures(captures, spark.createDataFrame(ENTRIES, "key string, at long, listed boolean, reason string"))
    keys = [["a.example.com/p", "a.example.com", "example.com"], ["deep.www.example.org", "www.example.org", "example.org"], ["b.example.net/x", "b.example.net", "example.net"], ["b.example.net/w", "b.example.net", "example.net"], ["tie.example.com", "example.com"], ["c.example.com", "example.com"], [], [], []]

    def want(k, at):
        for key in keys[k]:
            known = [e for e in ENTRIES if e[0] == key and e[1] is not None and e[2] is not None and at is not None and e[1] <= at]
            if known:
                last = sorted((e for e in known if e[1] == max(x[1] for x in known)), key=lambda e: (not e[2], e[3] or ""))[0]
                if last[2]:
                    return (True, key, last[1], last[3])
        return (False, None, None, None)

    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.blocked, r.matched_key, r.listed_since, r.reason) == want(r.page_id, r.fetched), r
    none = spark.createDataFrame([], "key string, at long, listed boolean, reason string")
    assert url_filter.filter_captures(captures, none).where("blocked").count() == 0
    assert url_filter.filter_captures(captures.limit(0), none).count() == 0


def test_captures_of_deep_hosts_and_paths(spark):
    entries = [("example.com", 0, True, "domain"), ("host.net/a/b", 0, True, "path"), ("host.net/a/b/c/d", 50, True, "deep"), ("x.y.z.host.org", 0, True, "sub"), ("host.org", 0, True, "root")]
    want = {
        "http://a.b.c.d.example.com/q": "example.com", "http://host.net/a/b": "host.net/a/b", "http://host.net/a//b/c/d/e?q": "host.net/a/b/c/d",
        "http://host.net/a/c/b": None, "http://host.net/a": None, "http://w.x.y.z.host.org/": "x.y.z.host.org", "http://v.w.y.z.host.org": "host.org", "http://notexample.com": None,
    }
    captures = spark.createDataFrame([(u, 100) for u in want] * 2, "url string, fetched long")
    got = url_filter.filter_captures(captures, spark.createDataFrame(entries, "key string, at long, listed boolean, reason string")).collect()
    assert len(got) == 2 * len(want) and all(r.matched_key == want[r.url] and r.blocked == (want[r.url] is not None) for r in got)


def test_entries_in_any_spelling_block(spark):
    spellings = ["Example.com", "example.org.", "host.net/a/", "HTTPS://user@Port.io:8080/P//q/?x#y", "//bare.dev/", " space.me "]
    entries = [(k, 10, True, "spam") for k in spellings] + [("EXAMPLE.com.", 50, False, "spam"), ("http://", 10, True, "spam"), ("/path", 10, True, "spam")]
    urls = ["http://www.example.com/x", "http://example.org/", "http://host.net/a/b", "http://port.io/P/q/r", "http://port.io/p/q", "http://bare.dev", "http://SPACE.me./z", "http://path/"]
    captures = spark.createDataFrame([(u, t) for u in urls for t in (9, 20, 60)], "url string, fetched long")
    rows = spark.createDataFrame(entries, "key string, at long, listed boolean, reason string")
    got = {(r.url, r.fetched): r.matched_key for r in url_filter.filter_captures(captures, rows).collect()}
    keys = ["example.com", "example.org", "host.net/a", "port.io/P/q", None, "bare.dev", "space.me", None]
    assert got == {(u, t): None if t == 9 or (k == "example.com" and t == 60) else k for u, k in zip(urls, keys, strict=True) for t in (9, 20, 60)}
