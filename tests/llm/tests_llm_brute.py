"""Plain versions that several tests compare with."""

import re
import zlib

import numpy as np
import xxhash

from graphloom.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: {id: fingerprint}; the smallest id reachable over at most three differing bits."""
    ids, label = sorted(fps), {}
    for i in ids:
        if i in label:
            continue
        stack, label[i] = [i], i
        while stack:
            x = stack.pop()
            for y in ids:
                if y not in label and (fps[x] ^ fps[y]).bit_count() <= 3:
                    label[y] = i
                    stack.append(y)
    return label


def brute_lines(rows, least=0.8):
    """(id, text that stays, lines that went) of every row, in order."""
    def place(r):
        tag = xxhash.xxh64_intdigest((r[1] or "").encode(), 42) if r[1] is not None else 42
        return r[0] is None, r[0] or 0, tag - (1 << 64) if tag >> 63 else tag

    occurrences = [(*place(r), n, x) for r in {place(r): r for r in rows}.values() for n, x in enumerate(lines.line_list(r[1])) if x]
    strings = sorted({o[4] for o in occurrences})
    sets, parent = [lines.shingles(x) for x in strings], list(range(len(strings)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(strings)):
        for j in range(i):
            if top(i) != top(j) and lines.jaccard(sets[i], sets[j]) >= least:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    at, first = {x: i for i, x in enumerate(strings)}, {}
    for o in occurrences:
        first[top(at[o[4]])] = min(o, first.get(top(at[o[4]]), o))
    stays = {o[:4] for o in first.values()}
    gone = {o[:4] for o in occurrences} - stays
    out = []
    for r in rows:
        kept = [x for n, x in enumerate((r[1] or "").split("\n")) if (*place(r), n) not in gone]
        went = len((r[1] or "").split("\n")) - len(kept)
        out.append((r[0], r[1] if not went else "\n".join(kept), went))
    return out
