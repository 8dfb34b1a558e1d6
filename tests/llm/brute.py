"""Plain versions of the contracts, written from their wording."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix_targets(rows):
    """source -> (size, target) by sharing the excess again and again."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(SPACE_WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return {s: (sizes[s], target[s]) for s in names}


def base_secrets(text):
    text = text or ""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|""" \
             r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    kinds = Counter(k for _, k, _ in found)
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(line.encode()).hexdigest(), line


def archive_rows(pages):
    payload = {p: (h or "").encode() for p, h in pages}
    largest = defaultdict(int)
    for p, data in payload.items():
        largest[data] = max(largest[data], p)
    return sorted((p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(),
                   "response" if largest[d] == p else "revisit", None if largest[d] == p else largest[d])
                  for p, d in payload.items())


def url_rule(url):
    """(host, path, rule, verdict or None)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = host.translate(LOW)
    best = None
    for h, p, verdict in (("net", "/", "block"), ("example.net", "/en/", "allow"),
                          ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (not best or len(h + p) > len(best[0])):
            best = h + p, verdict
    return host, path, best and best[0], best and best[1]


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    starts, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"),
                          ("cc by", "cc-by"), ("mit license", "mit")):
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def shingles(text):
    words = SPACE_WORD.findall((text or "").translate(LOW))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def components(docs):
    """doc_id -> (set size, least reachable id) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def edit_passage(item, text, k):
    """Least word edits between the item and any passage of the text, if at most k."""
    norm = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())
    a, b = norm(item), norm(text)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    best = min(row)
    return best if a and best <= k else None
