"""The prefix trie of rebuilt conversations, node by node in plain Python."""

import hashlib
import zlib


def rebuild(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1], t[2]))
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        b = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        base = convs.get(b, [])
        out[c] = [(r, t) for _, r, t in base[:h]] + [(r, t) for _, r, t in turns[h:]]
    return out


def trie(rows):
    convs = rebuild(rows)
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    found = []
    for key, ms in members.items():
        stack, leaves, saved = [key], 0, 0
        while stack:
            k = stack.pop()
            kids = children.get(k, [])
            leaves += not kids
            saved += (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
            stack.extend(kids)
        ends = sorted(c for c in ms if len(convs[c]) == len(key))
        found.append((
            min(ms), len(key), min(members[key[:-1]]) if key else None, len(ms), len(children.get(key, [])), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=repr)
