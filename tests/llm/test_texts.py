import hashlib
import random
import re

import numpy as np
import xxhash

from tests.llm.tables import WORD, collected, corpus, docs, prose
from tidemark.llm import fingerprints, pii, substrings


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, np.inf), np.inf if i is None else i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (np.inf if i is None else i):
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def test_repeats_against_all_windows(spark):
    rows = corpus()
    for chunk_rows in (3, 1000):
        got = substrings.without_repeats(docs(spark, rows), chunk_rows=chunk_rows).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_repeats(rows)
        for r in got:
            assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed
            assert all(s["last"] - s["first"] >= 12 for s in r.spans)


def test_repeats_of_an_empty_table(spark):
    assert substrings.without_repeats(docs(spark, [])).count() == 0


def test_next_document_and_edited_text(spark):
    rows = corpus()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    got = collected(fingerprints.edited_fingerprints(docs(spark, rows)))
    assert sum(map(len, got.values())) == len(rows)
    for (i, t), (j, u) in zip(order, order[1:]):
        if i in (50, 51) or i == j:
            continue
        t, u = t or "", u or ""
        n = len(t) // 4
        assert got[i][0].edited == t[: len(t) - n] + u[:n] and got[i][0].n_chars == len(t)
    by_text = {}
    for i, own in got.items():
        for r in own:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            text = {t for k, t in rows if k == i}
            if len(text) == 1:
                by_text.setdefault(text.pop() or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_last_document_meets_the_first(spark):
    got = collected(fingerprints.edited_fingerprints(docs(spark, [(5, "bbbbbbbb"), (9, "cccccccc"), (2, "aaaaaaaa")])))
    assert {i: r[0].edited for i, r in got.items()} == {2: "aaaaaabb", 5: "bbbbbbcc", 9: "ccccccaa"}
    assert fingerprints.edited_fingerprints(docs(spark, [(1, "abcdefgh")])).first().near_next == 1.0
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0


def test_likeness_follows_order_and_edits(spark):
    base = prose(1, 400).split()
    few, many, turned = list(base), list(base), base[200:] + base[:200]
    for k in range(0, 400, 80):
        few[k] = "edit"
    for k in range(0, 400, 8):
        many[k] = "edit"
    shuffled = random.Random(1).sample(base, 400)
    rows = [(i, " ".join(x)) for i, x in enumerate((base, few, many, shuffled, turned))]
    entries = fingerprints.with_entries(docs(spark, rows).select("doc_id", "text"), "text", "e").collect()
    sets = {r.doc_id: set(r.e) for r in entries}
    like = {i: len(sets[0] & sets[i]) for i in sets}
    assert like[0] > like[1] > like[2] >= like[3] and like[4] > like[3]


def test_occurrences_are_numbered(spark):
    """A text and its double have different fingerprints though their k-mers are the same set."""
    rows = docs(spark, [(1, "ab cd " * 40), (2, "ab cd " * 400), (3, None), (4, "  ")])
    found = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(rows).collect()}
    assert found[1] != found[2] and found[3] == "" != found[4]


def plain_entries(text):
    """Fingerprint entries by plain loops; hashes are xxHash64, chained by seed."""
    as_bytes = text.encode().decode("latin-1")
    pieces, at = [], 0
    kind = [b * fingerprints.MULTIPLIER % 256 * fingerprints.CLASSES // 256 for b in range(256)]
    while at < len(as_bytes):
        for c in range(fingerprints.CLASSES):
            i = at
            while i < min(len(as_bytes), at + fingerprints.REACH - 1) and kind[ord(as_bytes[i])] != c:
                i += 1
            end = i
            while end < min(len(as_bytes), i + fingerprints.REACH) and kind[ord(as_bytes[end])] == c:
                end += 1
            if end > i:
                break
        pieces.append(as_bytes[at:end])
        at = end

    def chained(parts):
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        return h

    k = fingerprints.K
    grams = [tuple(pieces[i : i + k]) for i in range(max(len(pieces) - k + 1, 1 if pieces else 0))]
    mask = (1 << 64) - (1 << fingerprints.PLACE_BITS)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    seen, packed = {}, []
    for i, h in enumerate(chained(g) & mask for g in grams):
        n = seen[h] = seen.get(h, -1) + 1
        first = xxhash.xxh64_intdigest(signed(h).to_bytes(8, "little", signed=True), 42)
        packed.append((xxhash.xxh64_intdigest(n.to_bytes(4, "little"), first) & mask, i))
    out = []
    bits = fingerprints.BIN_BITS
    for b in range(1 << bits):
        own = sorted((signed(h | i), i, h) for h, i in packed if h >> (64 - bits) == b)[: fingerprints.TUPLE]
        if own:
            h = 42
            for _, _, e in sorted(own, key=lambda x: x[1]):
                h = xxhash.xxh64_intdigest((e >> fingerprints.PLACE_BITS).to_bytes(8, "little"), h)
            out.append(b << (32 - bits) | h & ((1 << (32 - bits)) - 1))
    return sorted(out)


def plain_likeness(a, b):
    bins = {x >> (32 - fingerprints.BIN_BITS) for x in (*a, *b)}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def test_fingerprints_against_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(["", "a", "ab" * 40, "x" * 200, "世界" * 30, prose(1, 60), prose(2, 300), " \n\t ", prose(3, 5) * 20, "é"])]
    got = collected(fingerprints.edited_fingerprints(docs(spark, rows)))
    entries = [plain_entries(t) for _, t in rows]
    for i, t in rows:
        r = got[i][0]
        assert r.fingerprint == "".join(f"{e:08x}" for e in entries[i]), t
        other = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        changed = plain_entries(t[: len(t) - cut] + other[:cut])
        assert r.edited_fingerprint == "".join(f"{e:08x}" for e in changed)
        assert abs(r.near_edited - plain_likeness(entries[i], changed)) < 1e-12
        assert abs(r.near_next - plain_likeness(entries[i], entries[(i + 1) % len(rows)])) < 1e-12


def test_one_sign_more_changes_little(spark):
    r = random.Random(1)
    chinese = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4000))
    code = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))
    for text in (chinese, code, "ab" * 2000, prose(7, 900)):
        m = len(text) // 2
        variants = ["b" + text, text[:m] + "x" + text[m:], text[:m] + text[m + 1 :], text + "z"]
        table = spark.createDataFrame([(text, v) for v in variants], "x string, y string")
        table = fingerprints.with_entries(fingerprints.with_entries(table, "x", "a"), "y", "b")
        assert min(r[0] for r in table.select(fingerprints.likeness("a", "b")).collect()) > 0.9
        moved = spark.createDataFrame([(text, text[m:] + text[:m])], "x string, y string")
        moved = fingerprints.with_entries(fingerprints.with_entries(moved, "x", "a"), "y", "b")
        assert text.startswith("abab") or moved.select(fingerprints.likeness("a", "b")).first()[0] < 0.8


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    checks = (
        lambda m, d: True,
        lambda m, d: all(int(x) <= 255 for x in m.split(".")),
        lambda m, d: 13 <= len(d) <= 19 and plain_luhn(d),
        lambda m, d: 9 <= len(d) <= 15,
    )
    out = []
    for pattern, check in zip(PATTERNS, checks):
        found = re.finditer(pattern, text)
        out.append([m.span() for m in found if check(m.group(), re.sub("[^0-9]", "", m.group()))])
    return out


def test_base_spans_as_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("a.@-1 29+()0x4_%") for _ in range(r.randrange(50)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111")[2] == [(0, 19)]
    for awkward in ("a" * 200_000, "1" * 200_000, "+1" + " " * 200_000, "@" * 50_000, "1." * 50_000):
        pii.base_spans(awkward)


def agents():
    """Six texts name zephyr beside an address, one without it; agent is a common word; one text is there twice."""
    rows = [(i, f"{prose(i, 8)} agent zephyr writes from kim@example.org daily {prose(900 + i, 9)}") for i in range(6)]
    rows += [(500 + i, f"{prose(40 + i, 20)} agent {prose(60 + i, 10)}") for i in range(60)]
    rows += [(200 + i, prose(2000 + i, 30)) for i in range(60)]
    rows += [(400, "quiet Zephyr sails at dawn"), (401, rows[0][1]), (402, rows[0][1])]
    rows += [(30, None), (31, ""), (32, "é call +1 (323) 555-9830 now"), (None, "kim@example.org"), (32, "é call +1 (323) 555-9830 now")]
    return rows


def plain_terms(text):
    """Words outside base spans with their places."""
    spans = [s for own in brute_spans(text) for s in own]
    found = []
    for m in re.finditer(r"[^\x00-\x20!-/:-@\[-`{-\x7f]+", text):
        if not any(a < m.end() and b > m.start() for a, b in spans):
            found.append((re.sub("[A-Z]", lambda c: c.group().lower(), m.group()), *m.span()))
    return found


def plain_disclosures(rows):
    """Share of an entity's information that a term tells, for all pairs."""
    texts = [t or "" for _, t in rows]
    named = [set(pii.entities(t, brute_spans(t))) for t in texts]
    words = [{w for w, _, _ in plain_terms(t)} for t in texts]
    out = {}
    for e in set().union(*named):
        own = [i for i in range(len(texts)) if e in named[i]]
        if len({texts[i] for i in own}) < pii.SUPPORT or len(own) > pii.COMMON * len(texts):
            continue
        for t in set().union(*(words[i] for i in own)):
            both = [i for i in own if t in words[i]]
            every = sum(t in w for w in words)
            if len({texts[i] for i in both}) >= pii.SUPPORT:
                share = np.log(len(both) * len(texts) / (len(own) * every)) / -np.log(len(own) / len(texts))
                if share >= pii.GENERALISE:
                    out[t] = max(share, out.get(t, 0))
    return out


def test_personal_data(spark):
    rows = agents()
    table = docs(spark, rows)
    found = pii.personal_data(table)
    got = collected(found)
    assert sum(map(len, got.values())) == len(rows)
    told = plain_disclosures(rows)
    assert {"zephyr", "writes", "daily"} <= set(told) and "agent" not in told
    for i, text in rows:
        expected = brute_spans(text or "")
        for r in got[i]:
            assert r.base == pii.joined(pii.KINDS, expected)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in expected]
            want = [(a, b, told[w]) for w, a, b in plain_terms(text or "") if w in told]
            assert [(t.start, t.end) for t in r.terms or []] == [x[:2] for x in want]
            assert np.allclose([t.disclosure for t in r.terms or []], [x[2] for x in want])
            assert r.spans == ",".join(x for x in (r.base, *(f"term:{a}:{b}" for a, b, _ in want)) if x)
    # The name gives the person away where the address does not stand, too.
    assert [rows[126][1][t.start : t.end] for t in got[400][0].terms] == ["Zephyr"]
    assert got[30][0].spans == got[31][0].spans == "" and got[500][0].terms is None
    clean = {r.doc_id: r.text for r in pii.sanitised(table, found).collect()}
    assert "kim@" not in clean[0] and "zephyr" not in clean[0] and "[email]" in clean[0] and "agent" in clean[0]
    assert clean[400].startswith("quiet [") and "Zephyr" not in clean[400]
    assert clean[32] == "é call [phone] now" and clean[30] == "" and clean[500] == rows[6][1]
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_planted_names_are_recalled(spark):
    """Persons with an address and a nickname of their own in some texts; other texts have the nickname alone."""
    r = random.Random(8)
    rows = [(i, prose(i, 40)) for i in range(300)]
    want = set()
    for k in range(20):
        for j in range(4):
            rows.append((1000 + 10 * k + j, f"{prose(5000 + 10 * k + j, r.randint(5, 30))} nick{k:02d}x wrote user{k}@host{k}.example.org {prose(7000 + 10 * k + j, 10)}"))
        for j in (4, 5):
            rows.append((1000 + 10 * k + j, f"{prose(9000 + 10 * k + j, 12)} nick{k:02d}x"))
            want.add(1000 + 10 * k + j)
    found = {x.doc_id for x in pii.personal_data(docs(spark, rows)).collect() if x.terms and x.base == ""}
    assert len(found & want) >= 0.9 * len(want)
    assert len([i for i in found if i < 1000]) <= 30


def test_many_spans_cost_no_square():
    text = "a@b.cc word " * 60_000
    spans = pii.base_spans(text)
    hashes, first, last = pii.terms(text, spans)
    assert len(first) == 60_000 and (last - first == 4).all() and len(set(hashes.tolist())) == 1


def test_digest_of_spans():
    spans = brute_spans("a@b.cc 1.2.3.4 +1 234 567 890 b@c.dd")
    assert pii.joined(pii.KINDS, spans) == "email:0:6,email:30:36,ip:7:14,phone:15:29"
    assert len(hashlib.sha256(pii.joined(pii.KINDS, spans).encode()).hexdigest()) == 64
