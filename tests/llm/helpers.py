"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import regex

WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def remove_repeats(rows):
    """{id: (bytes, removed, spans, digest)} by looking up every 100-byte string."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone[i:i + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(x for x, r in zip(b, gone) if not r)
        out[d] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(t, n):
    w = re.findall(WORD, lower(t))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in ids}


def jaccard_components(rows, n, percent):
    sets = {d: shingle_set(t, n) for d, t in rows}
    at, both = defaultdict(list), defaultdict(int)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    for ids in at.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                both[a, b] += 1
    links = [p for p, c in both.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    comp = groups(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


NAME, NUM, UNIT = "<name>", "<num>", "<unit>"


def template_matches(docs, items, units, numbers, window=8, least=13, literal=2, short=4):
    """{(doc, item): (windows, slots, exact)} by comparing every window of every document with every window of every item, with
    names apart (templates, plain words, the words themselves) and with runs of names as one (templates)."""
    def words(text, runs):
        t = regex.sub(r"([0-9])[.,](?=[0-9])", "\\1\ue003", text or "")
        t = regex.sub(r"([0-9])(?=([\p{L}\p{N}]+))", lambda m: m[1] + " " * (m[2].lower() in units), t)
        pieces = regex.split(r"([\p{L}\p{N}]+)", t)  # every second one is a word
        for i in range(1, len(pieces) - 2, 2):
            if pieces[i].lower() in numbers and pieces[i + 2].lower() in numbers and regex.fullmatch(r"[- \t\n\x0b\f\r]+", pieces[i + 1]):
                pieces[i + 1] = "\ue003"
        t = "".join(pieces)
        names = {m.end() for m in regex.finditer(r"[\p{Ll}0-9,;][ \t\n\x0b\f\r]+[\"'`(\[{<]*(?=\p{Lu})", t)}
        found = []
        for m in regex.finditer(r"[^ \t\n\x0b\f\r!-/:-@\[-`{-~]+", t):
            named, before = m.start() in names, found and t[found[-1][2]:m.start()]
            if runs and named and found and before.strip(" \t\n\x0b\f\r") == "" and regex.search(r"\p{Lu}[^ \t\n\x0b\f\r!-/:-@\[-`{-~]*$", t[found[-1][3]:found[-1][2]]):
                found[-1][2:] = m.end(), m.start()  # of names in a row the first stands for all
            else:
                found.append([m[0], named, m.end(), m.start()])
        return [(w.lower(), named) for w, named, *_ in found]

    def kind(w, named):
        if w[0] in "0123456789" or all(v in numbers for v in w.split("\ue003")):
            return NUM
        return NAME if named else UNIT if w in units else w

    def slot(x):
        return x[1] or kind(*x) in (NUM, UNIT)

    def keys(w, item, runs):
        out = defaultdict(set)
        for i in range(len(w) - window + 1):
            part = w[i:i + window]
            t, p, x = (tuple(kind(*v) for v in part), tuple(kind(v[0], False) for v in part), tuple(v[0] for v in part))
            enough = lambda k: sum(v not in (NAME, NUM, UNIT) for v in k) >= literal
            if not item or enough(t):
                out[t].add(i)
            if runs:
                continue
            if not item or enough(p):
                out[p].add(i)
            if not item or not enough(p):
                out["=", x].add(i)
        return out

    def value(x):
        return str(numbers.get(x[0], x[0]))

    found = {}
    for runs in (False, True):
        whole = {k: words(t, runs) for k, t in items}
        index = {k: keys(w, True, runs) for k, w in whole.items()}
        for d, text in docs:
            w = words(text, runs)
            mine = keys(w, False, runs)
            for k, it in whole.items():
                at = defaultdict(set)
                if not runs and short <= len(it) < window:
                    for i in range(len(w) - len(it) + 1):
                        if [v[0] for v in w[i:i + len(it)]] == [v[0] for v in it]:
                            at[i].add(0)
                for key, places in index[k].items():
                    for j in mine.get(key, ()):
                        for i in places:
                            at[j - i].add(i)
                for shift, places in at.items():
                    if len(places) < max(1, min(least - window + 1, len(it) - window + 1)):
                        continue
                    lo, hi = min(places), min(max(places) + window, len(it))
                    pairs = [(value(a), value(b)) for a, b in zip(it[lo:hi], w[lo + shift:hi + shift]) if slot(a) and slot(b)]
                    same = sum(a == b for a, b in pairs)
                    if len(set(pairs)) == len({a for a, _ in pairs}) or 2 * same > len(pairs):
                        found[d, k] = max(found.get((d, k), (0, 0, False)), (len(places), len(pairs), same == len(pairs)))
    return found
