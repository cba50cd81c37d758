"""Near copies, benchmark passages, lines and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from catalogspark.llm import components, decontaminate, lines, ngrams

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def find(links, n):
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near(rows, size, percent):
    own = [shingles(text, size) for _, text in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])
    ]
    roots, out, ids = find(links, len(rows)), [], defaultdict(list)
    for (doc, _), root in zip(rows, roots):
        ids[root].append(doc)
    for (doc, _), root, x in zip(rows, roots, own):
        known = [d for d in ids[root] if d is not None]
        out.append((str(doc), len(x), str(min(known) if known else None)))
    return sorted(out)


def got_near(df, size, percent):
    got = ngrams.jaccard_components(df, size, percent).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def test_near_copies_of_odd_documents(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for size, percent in ((3, 90), (5, 80)):
        assert got_near(odd, size, percent) == near(rows, size, percent)
    assert ngrams.jaccard_components(none).collect() == []


@pytest.mark.parametrize("block", [512, 3])
def test_chains_and_groups_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    r = random.Random(7)
    rows = []
    for group in range(6):
        words = [f"w{r.randrange(400)}" for _ in range(90)]
        for copy in range(14):
            words = list(words)
            for _ in range(r.randrange(3)):  # drifts away from the first
                words[r.randrange(len(words))] = f"v{r.randrange(9999)}"
            rows.append((len(rows), " ".join(words[: 90 - r.randrange(2)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, percent in ((3, 90), (5, 80), (3, 50)):
        assert got_near(df, size, percent) == near(rows, size, percent)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    edges += [(5000, 5001 + i) for i in range(60)]
    roots = find(edges, 6000)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(map(tuple, got)) == sorted((x, roots[x]) for x in nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def passages(docs, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))
    wanted = [
        (key, own[i : i + window]) for key, text in items if (own := words(text))
        for i in range(max(1, len(own) - window + 1))
    ]
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        at = defaultdict(list)
        for i, word in enumerate(own):
            at[word].append(i)
        for key, w in wanted:
            for i in at[w[0]]:
                if own[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(key)) if key is not None else None
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc), len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out)


def test_passages(spark, odd, none):
    r = random.Random(11)
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    long = re.split(r"\s+", rows[[d for d, _ in rows].index(11)][1])
    items = [
        (i, " ".join(long[at : at + r.choice([1, 2, 3, 5, 12, 13, 14, 30])]).title())
        for i, at in enumerate(r.randrange(30_000) for _ in range(25))
    ]
    items += [(3, "one"), (None, "one two"), (70, None), (71, ""), (72, "- -"), (7, items[0][1]), (9, "nowhere at all"), (9, "日本語 の")]
    rows += [(900, "the " * 30), (901, f"x {items[0][1]} {items[0][1]} y"), (902, "日本語, の: 文 " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, row int")
    got = decontaminate.contamination(docs, bench).drop("items").collect()
    assert sorted((str(g[0]), *g[1:]) for g in got) == passages(rows, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {g.n_hit for g in decontaminate.contamination(docs, empty).collect()} == {0}
    assert decontaminate.contamination(none, bench).collect() == []


def template_lines(rows):
    """[(doc_id, text)] of distinct documents -> {place in rows: (lines, dropped, text)}."""
    held, distinct = [], {}
    for k, (doc, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n") if text else []):
            plain = re.sub("[ \t\r]+", " ", line).strip(" ")
            masked = re.sub("[^ ]*[0-9][^ ]*", "<*>", plain)
            if len(masked.split(" ")) - masked.count("<*>") < 5:
                masked = plain
            tokens = masked.split(" ")
            if len(tokens) >= 5 or len(masked) >= 40:
                held.append((doc is None, doc, k, at, masked))
                distinct.setdefault(masked, (len(tokens), *tokens[:3]))
    docs_of = defaultdict(set)
    for _, _, k, _, masked in held:
        docs_of[distinct[masked]].add(k)
    leaves = defaultdict(list)
    for masked, leaf in distinct.items():
        leaves[leaf].append(masked.split(" "))
    name = {}
    for masked, leaf in distinct.items():
        own, tokens = leaves[leaf], masked.split(" ")
        name[masked] = masked
        if leaf[0] >= 8 and len(own) >= 10 and len(docs_of[leaf]) > 1:
            top = [min(Counter(x[i] for x in own).items(), key=lambda c: (-c[1], c[0]))[0] for i in range(leaf[0])]
            like = lambda x: sum(a != b for a, b in zip(top, x)) <= max(1, leaf[0] // 20)  # noqa: E731, B023
            if like(tokens) and sum(map(like, own)) >= 10:
                name[masked] = leaf
    groups = defaultdict(list)
    for row in held:
        groups[name[row[4]]].append(row)
    drop = defaultdict(set)
    for own in groups.values():
        if len({k for _, _, k, _, _ in own}) > 1:
            for row in sorted(own, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))[1:]:
                drop[row[2]].add(row[3])
    out = []
    for k, (doc, text) in enumerate(rows):
        split = text.split("\n") if text else []
        kept = text if k not in drop else "\n".join(x for i, x in enumerate(split) if i not in drop[k])
        out.append((str(doc), len(split), len(drop[k]), str(kept)))
    return sorted(out)


def test_unlike_lines_stay(spark):
    """Rows of numbers and sentences that differ in a word are no templates; equal
    long lines without blanks are."""
    numbers = ["\n".join(" ".join(str(d * 1000 + i * 7 + k) for k in range(6)) for i in range(20)) for d in (1, 2)]
    chapters = [f"Chapter one begins with a very {w} night here" for w in ("long", "cold", "dark")]
    script = "。".join(["日本語の長い文章がここに続きます"] * 4)
    rows = [*enumerate(numbers), *enumerate(chapters, 10), (20, script), (21, script), (22, "Yes.\nYes."), (23, "Yes.")]
    rows += [(30 + i, f"user logged in from host {w} at noon today {i}") for i, w in enumerate("abcdefghijkl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc.doc_id: (r.n_dropped, r.doc.text) for r in lines.drop_lines(docs).collect()}
    assert all(got[d] == (0, t) for d, t in rows if d < 21 or 22 <= d < 30)
    assert got[21] == (1, "") and got[30][0] == 0 and all(got[d] == (1, "") for d in range(31, 42))
    want = [(str(d), n, dropped, t) for d, n, dropped, t in template_lines(rows)]
    assert sorted((str(r.doc.doc_id), r.n_lines, r.n_dropped, r.doc.text) for r in lines.drop_lines(docs).collect()) == want


def test_line_templates(spark, odd, none):
    r = random.Random(2)
    rows = [(i, t) for i, t in {(x.doc_id, x.text) for x in odd.collect()} if i is not None]
    for i in range(60):
        body = [f"user {r.randrange(99)} logged in from host {r.choice('abc')} at noon"] * r.randrange(3)
        body += ["read the manual of this site first", f"step {i} of the long and winding road to nowhere number {i}"]
        body += ["  spaced\tout   line of words ", "too short", "a quite unique " + " ".join(f"q{r.random()}"[:5] + "x" for _ in range(9))]
        r.shuffle(body)
        rows.append((1000 + i, "\n".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).repartition(4)
    got = lines.drop_lines(df.selectExpr("*", "1 AS dk", "2 AS `drop`", "3 AS n_lines", "'x' AS `a.b`"))
    assert got.select("doc.*").columns == ["doc_id", "text", "dk", "drop", "n_lines", "a.b"]
    got = sorted((str(g.doc.doc_id), g.n_lines, g.n_dropped, str(g.doc.text)) for g in got.collect())
    assert got == template_lines(rows)
    assert lines.drop_lines(none).collect() == []
    assert lines.drop_lines(odd).count() == odd.count()


def test_line_dedup_is_native(odd):
    plan = lines.drop_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
