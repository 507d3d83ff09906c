"""Plain Python versions of the operators, for small tables of dicts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def mix(rows, weights=(5, 2, 1), most=3):
    """{row number: (size, source_size, target)}"""
    size = [len(words(r["text"])) for r in rows]
    total = Counter()
    for r, n in zip(rows, size):
        total[r["source"]] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode())
    names += [None] if None in total else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(total.values())
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / share > most * total[s]]
        if not over:
            target.update({s: rest * weight[s] / share for s in open_})
            break
        target.update({s: most * total[s] for s in over})
        rest -= sum(most * total[s] for s in over)
        open_ -= set(over)
    return [(n, total[r["source"]], target[r["source"]]) for r, n in zip(rows, size)]


def lines(rows, min_chars=10, min_docs=2):
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and len(key(x)) >= min_chars:
                holders[key(x)].add(r["doc_id"])
    out = []
    for r in rows:
        all_ = (r["text"] or "").split("\n")
        kept = [x for x in all_ if r["doc_id"] is None or len(holders.get(key(x), ())) < min_docs
                or min(holders[key(x)]) == r["doc_id"]]
        out.append((r["doc_id"], len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def base_scores(rows):
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    count = Counter(w for r, h in zip(rows, held) if not h for w in tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    return [(r["doc_id"], h, len(tokens(r["text"])), sum(w in count for w in tokens(r["text"])), n,
             sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(r["text"]))) for r, h in zip(rows, held)]


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def near_components(rows, size, percent=80):
    """(doc_id, set size, component) of every row, by comparing every pair that shares a shingle."""
    sets = [shingle_set(r["text"], size) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i]["doc_id"] is None:
            continue
        common = Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], len(s), least.get(find(i)) if r["doc_id"] is not None else None)
            for i, (r, s) in enumerate(zip(rows, sets))]


def substrings(rows, length=50):
    first = {}
    data = [(r["text"] or "").encode() for r in rows]
    for r, b in zip(rows, data):
        if r["doc_id"] is not None:
            for i in range(len(b) - length + 1):
                x = b[i:i + length]
                first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    out = []
    for r, b in zip(rows, data):
        drop = bytearray(len(b))
        if r["doc_id"] is not None:
            for i in range(len(b) - length + 1):
                if first[b[i:i + length]] < r["doc_id"]:
                    drop[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if drop[i] and not (i and drop[i - 1]))
        out.append((r["doc_id"], len(b), sum(drop), spans, bytes(c for c, d in zip(b, drop) if not d)))
    return out


def text_stats(text):
    x, w = text or "", words(text)
    count = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(hit)


def passages(rows, items, size=10):
    windows = defaultdict(set)
    for r in items:
        w = NORMAL.findall((r["text"] or "").translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(None if r["item_id"] is None else str(r["item_id"]))
    out = []
    for r in rows:
        w = NORMAL.findall((r["text"] or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((r["doc_id"], len(w), len(hit), sorted(found - {None})))
    return out


def views(turns, system=("system",), per_part=256):
    """(conv, speaker, part, turns, own turns, text, mask) of every participant's view."""
    convs = defaultdict(list)
    for t in turns:
        convs[t["conv_id"]].append(((t["turn"] is not None, t["turn"] or 0), (t["role"] or "unknown").encode(),
                                    (t["text"] or "").encode(), t["role"] or "unknown", bool(t["role"]), t["text"] or ""))
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: r[:3])
        for speaker in {r[3] for r in rows if r[4] and r[3] not in system}:
            for part in range(-(-len(rows) // per_part)):
                text, mask, own = "", [], 0
                some = rows[part * per_part:(part + 1) * per_part]
                for _, _, _, role, _, said in some:
                    name = "assistant" if role == speaker else "system" if role in system else f"user name={role}"
                    text += f"<|{name}|>\n"
                    if role == speaker:
                        mask.append((len(text), len(text) + len(said) + len("<|end|>")))
                        own += 1
                    text += said + "<|end|>\n"
                out.append((conv, speaker, part, len(some), own, text, tuple(mask)))
    return out


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shrunk(groups, prior):
    """{key: posterior mean} from {key: values} and {key: prior mean}."""
    n, g = sum(map(len, groups.values())), len(groups)
    mean = {k: sum(v) / len(v) for k, v in groups.items()}
    k_ = 1e6
    if g > 1 and n > g:
        within = sum(max(0.0, sum(x * x for x in v) - len(v) * mean[k] ** 2) for k, v in groups.items())
        between = sum(len(v) * (mean[k] - prior[k]) ** 2 for k, v in groups.items())
        p = sum(len(v) * prior[k] for k, v in groups.items()) / n
        spread = (between - within / (n - g) * g) / n
        if spread > 0:
            k_ = min(1e6, max(1.0, p * (1 - p) / spread - 1))
    return {k: (sum(v) + k_ * prior[k]) / (len(v) + k_) for k, v in groups.items()}


def site_probabilities(rows):
    """[(host posterior, path posterior, probability)] of rows (host, path, log odds)."""
    sigmoid = lambda z: 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, z in rows:
        hosts[host].append(sigmoid(z))
        paths[host, path].append(sigmoid(z))
    overall = sum(sigmoid(z) for *_, z in rows) / len(rows)
    host_mean = shrunk(hosts, dict.fromkeys(hosts, overall))
    path_mean = shrunk(paths, {k: host_mean[k[0]] for k in paths})
    return [(host_mean[h], path_mean[h, p], sigmoid(z + logit(path_mean[h, p]) - logit(overall))) for h, p, z in rows]
