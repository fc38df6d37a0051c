"""Plain versions of the text operators, written from the definitions, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash

SPACES = " \t\n\x0b\f\r"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def words(text):
    return (text or "").encode().split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def line_dedup(texts, least=10):
    """(lines, dropped, kept text) per text."""
    key = lambda line: lower(line.strip(SPACES))
    seen = Counter()
    for text in texts:
        seen.update({key(x) for x in (text or "").split("\n")})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15)
            if good:
                out.append((kind, *m.span()))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"""
    text = text or ""
    own = [w.decode() for w in words(text)]
    windows = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n, chars = len(own), sum(map(len, own))
    symbols, dup = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    kept = not (failed or 100 * symbols > 10 * n or chars < 2 * n or chars > 16 * n or 100 * dup > 50 * len(lines))
    return n, chars, symbols, dup, len(covered), failed, kept


def fingerprint(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[i:i + 3]) for i in range(len(own) - 2)] or ([b" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps, budget=2):
    """For each position the smallest position that links reach."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def targets(sizes):
    """Target per source (None last) from the sizes per source, share by share."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest, w = total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        now = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w if w else 0.0 for s in order}
        above = {s for s in order if s not in full and now[s] > 2 * sizes[s]}
        if not above:
            return now
        full |= above


def token_ids(text, tokenizer=[]):
    if not tokenizer:
        from tokenizers import Tokenizer
        tokenizer.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return tokenizer[0].encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, texts):
    """rows of pieces against a list of (doc_id, text); the share of padding."""
    whole = defaultdict(list)
    for r in rows:
        whole[r.sequence_id].append(r)
    padding = tokens = 0
    for pieces in whole.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = Counter()
    starts = defaultdict(set)
    for r in rows:
        starts[r.doc_id, r.doc_tokens].add((r.start, r.length))
    for doc_id, text in texts:
        ids = token_ids(text)
        at = 0
        for start, length in sorted(starts[doc_id, len(ids)]):
            if start != at:
                continue
            crc = zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
            want[doc_id, start, length, crc, len(ids)] += 1
            at += length
        assert at == len(ids)
    assert got == want
    return padding / max(1, tokens)


def bm25(docs, queries, top=10):
    """{query id: [(score to 7 places, doc_id)]}; docs and queries are lists of (id, text)."""
    bags = [(i, Counter((t or "").encode().lower().split())) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    mean = sum(n for *_, n in bags) / max(1, len(bags))
    df = Counter(w for _, b, _ in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = {}
    for q, text in queries:
        asked = set((text or "").encode().lower().split())
        found = []
        for i, b, n in bags:
            s = math.fsum(idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in asked if w in b)
            if s > 0:
                found.append((-round(s, 7), i is None, i or 0))
        if found:
            out[q] = [(-s, None if null else i) for s, null, i in sorted(found)[:top]]
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def alignment(docs):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of (doc_id, text), both texts encoded as a whole."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    printed = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]
    back = {chr(c): c for c in printed} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printed)}
    piece = lambda x: bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()
    aligned, counts, most = [], Counter(), defaultdict(int)
    for i, text in docs:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        of_a, of_b = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a], [piece(x) for x in ids_b]
        if not text or not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            aligned.append((i, [], [], [], []))
            continue
        ends_a, ends_b = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in own]))} for own in (of_a, of_b))
        from_a, from_b, links, groups = 0, 0, [], []
        for end in sorted(ends_a.keys() & ends_b.keys()):
            k, j = ends_a[end] + 1, ends_b[end] + 1
            links.append((ids_a[k - 1], ids_b[j - 1]))
            groups.append(",".join(map(str, ids_a[from_a:k])) + "|" + ",".join(map(str, ids_b[from_b:j])))
            from_a, from_b = k, j
        counts.update(links)
        aligned.append((i, ids_a, ids_b, links, groups))
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
            for i, ids_a, ids_b, links, groups in aligned]


def collocations(docs, least, most=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            own = re.findall("[^ \t]+", piece)
            n[lang] += len(own)
            f.update((lang, tuple(own[i:i + k])) for k in range(1, most + 1) for i in range(len(own) - k + 1))
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = defaultdict(int)
    for (lang, words_), a in often.items():
        for k in range(2, len(words_)):
            for i in range(len(words_) - k + 1):
                inside[lang, words_[i:i + k]] = max(inside[lang, words_[i:i + k]], a)
    out = defaultdict(list)
    for (lang, words_), a in often.items():
        if inside[lang, words_] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, words_[:k]] * f[lang, words_[k:]]), k) for k in range(1, len(words_))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words_).encode(), f[lang, words_[:k]], f[lang, words_[k:]]))
    return [(lang, rank, phrase.decode(), -a, x, y, n[lang], -score)
            for lang, rows in out.items() for rank, (score, a, phrase, x, y) in enumerate(sorted(rows)[:top], 1)]


def exact_groups(docs):
    """(doc_id, keep_id, group_size, kept) of (doc_id, text)."""
    groups = defaultdict(list)
    for i, text in docs:
        groups[re.sub("[ \t-\r]+", " ", text or "")].append(i)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return out
