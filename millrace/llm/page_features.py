"""Measures of whole pages, taken from the code points of many texts at once (problem 9).

The texts of a slice are one array of code points. Links, tags and bare site names are masked out; what remains is cut into
words, and words, sentences, links and signs are counted per line and per text by grouping. No word list of any language is
used: prose is known by its sentences, lists of phrases by how they repeat and permute few words.

``FEATURES`` describe what kinds of lines make up a text and how its words repeat; trees are fitted on them. ``SIGNALS`` are
cruder measures of the text as a whole; weak labels are made of them, and no signal is a feature.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FEATURES = [
    "words", "variety", "hapax", "permuted", "top", "echo", "phrases", "repeated", "tagged", "links", "hosts", "host_variety", "per_link", "bare", "sentences",
    "sentence_count", "sentence_words", "refrain", "code", "digits", "lead", "uniform", "short", "lists",
]
SIGNALS = ["s_size", "s_words", "s_packed", "s_grams", "s_novelty", "s_stops", "s_hosts", "s_urls", "s_symbols", "s_numerals", "s_tail"]

#: Characters of a line from which it is read in pieces, and the length of a piece.
LONG_LINE, PIECE = 400, 300
#: Characters of text measured at once. A longer text is measured in windows of the second length and its values are
#: their means, weighted by size, so that the memory of a task is bounded.
SLICE, WINDOW = 300_000, 1_000_000
#: Words of a line per link up to which it is a link line.
PER_LINK = 7
#: Signs of an unspaced script in a row from which each counts as a word.
UNSPACED = 8
#: Lines a text needs before the likeness of its lines says anything.
FEW_LINES = 5

_INVISIBLE = "[­​-‏⁠-⁤﻿]"
_URL = re.compile(r"(?:https?:)?//(?:www\.)?([\w][\w.-]*\.\w\w[\w-]*)(?:[:/?#][^\s\"'<>)\]]*)?", re.IGNORECASE)
_TAG = re.compile(r"<(?:/?[a-z!?][^<>\n]*|/)>", re.IGNORECASE)
_SHOWN = re.compile(r"(?:title|alt|content|value|label)\s*=\s*(?:\"([^\"\n]*)\"|'([^'\n]*)')", re.IGNORECASE)
# Endings of source and data files; a dotted name that ends so is no site.
_FILES = frozenset(
    "bat bin c cc cfg cmd conf cpp cs css csv cxx db dll doc docx exe gif go gz h hpp htm html ico in ini ipynb jar java jpeg jpg js json jsx kt lock log "
    "lua md mjs o pdf php pl png properties py pyc rb rs rst scss sh so sql svg swift tar tex toml ts tsx txt vue wasm xls xlsx xml yaml yml zip".split()
)
# Signs that end sentences, part the entries of lists, and belong to program text.
_STOPS, _PARTING, _PROGRAM = ".!?。！？।؟۔", ",;|、，；،", "{}=<>\\^"

_LETTER, _DIGIT, _SPACE, _LINE, _SOLID, _UPPER, _STOP, _PART, _SIGN, _LOWER, _ASCII, _HOST = (np.uint16(1 << i) for i in range(12))
_WORD = _LETTER | _DIGIT
_K = np.uint64(0x9E3779B97F4A7C15)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Properties and lower-case form of each code point."""
    import regex

    flags = np.zeros(0x110000, np.uint16)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    solid = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+"
    for name, kind in ((r"[\p{L}\p{M}_]+", _LETTER), (r"\p{N}+", _DIGIT), (r"\s+", _SPACE), ("[\n\r\v\f\x1c-\x1e\x85  ]+", _LINE), (solid, _SOLID | _LETTER)):
        for m in regex.finditer(name, text):
            flags[points[m.start() : m.end()]] = kind
    fold = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(flags & _LETTER).tolist():
        low = chr(p).lower()
        if low != chr(p):
            flags[p] |= _UPPER
            if len(low) == 1:
                fold[p] = ord(low)
    flags[97:123] |= _LOWER | _ASCII
    flags[65:91] |= _ASCII
    letters = np.flatnonzero(flags[:0x250] & _LETTER)
    flags[letters[(flags[letters] & _UPPER) == 0]] |= _LOWER
    for signs, kind in ((_STOPS, _STOP), (_PARTING, _PART), (_PROGRAM, _SIGN), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-.", _HOST)):
        flags[[ord(c) for c in signs]] |= kind
    return flags, fold


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; groups by it are statistics, so a collision would only shift a share."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values told apart by their owner; the values must be spread already, as hashes are."""
    return _mix(values + owner.astype(np.uint64) * _K)


def _back(x: np.ndarray, first) -> np.ndarray:
    """Each place's left neighbour."""
    out = np.empty_like(x)
    out[0], out[1:] = first, x[:-1]
    return out


def _on(x: np.ndarray, last) -> np.ndarray:
    """Each place's right neighbour."""
    out = np.empty_like(x)
    out[-1], out[:-1] = last, x[1:]
    return out


def _cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a span."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of different values of each owner."""
    return np.bincount(owner[np.unique(_of(values, owner), return_index=True)[1]], minlength=n)


def _most(values: np.ndarray, owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Each owner's largest number (or weight) of one value."""
    _, first, group = np.unique(_of(values, owner), return_index=True, return_inverse=True)
    best = np.zeros(n)
    np.maximum.at(best, owner[first], np.bincount(group, weight, minlength=len(first)))
    return best


def _sites(s: str, p: np.ndarray, g: np.ndarray, fold: np.ndarray, flags: np.ndarray, free: np.ndarray) -> list[tuple[int, int, str]]:
    """Bare site names: dotted names of ASCII letters, digits and hyphens that end in letters and stand alone."""
    held = ((g & _HOST) > 0) & free
    dots = np.flatnonzero((p == 46) & held & ((_back(g, 0) & (_ASCII | _DIGIT)) > 0) & ((_on(g, 0) & _ASCII) > 0))
    if not len(dots):
        return []
    n = len(p)
    start, end = np.flatnonzero(held & ~_back(held, False)), np.flatnonzero(held & ~_on(held, False)) + 1
    run = np.unique(np.searchsorted(start, dots, "right") - 1)
    a, b = start[run], end[run]
    last = dots[np.searchsorted(dots, b) - 1]
    other = np.concatenate(([0], np.cumsum((g & _ASCII) == 0)))
    before, after, beyond = np.where(a > 0, p[a - 1], 32), p[np.minimum(b, n - 1)], p[np.minimum(b + 1, n - 1)]
    ok = ((g[a] & (_ASCII | _DIGIT)) > 0) & (b - last >= 3) & (other[b] == other[last + 1])
    ok &= ((flags[before] & _WORD) == 0) & ~np.isin(before, (64, 47, 92, 36)) & ((flags[after] & _WORD) == 0) & ~np.isin(after, (40, 61, 91, 64))
    ok &= ~((before == 91) & (after == 93) & (beyond != 40))  # the heading of a table of settings
    return [(x, y, s[x:y].lower()) for x, y, z in zip(a[ok].tolist(), b[ok].tolist(), last[ok].tolist()) if s[z + 1 : y].lower() not in _FILES]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """``FEATURES`` and ``SIGNALS`` of each text (large strings without nulls)."""
    flags, fold_of = _tables()
    n = len(texts)
    texts = pc.replace_substring_regex(texts, _INVISIBLE, "")
    each = texts.to_pylist()
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in each])))[:-1]
    s = "\n".join(each) + "\n"
    p = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    size, g, fold = len(p), flags[p], fold_of[p]

    # Lines, and the pieces of long ones.
    newline = (g & _LINE) > 0
    line = np.cumsum(newline) - newline
    at = np.flatnonzero(_back(newline, True))
    length = np.diff(np.append(at, size))
    pieces = np.where(length > LONG_LINE, -(-length // PIECE), 1)
    seg = (np.cumsum(pieces) - pieces)[line] + np.where(length[line] > LONG_LINE, (np.arange(size) - at[line]) // PIECE, 0)
    m = int(pieces.sum())
    text = np.searchsorted(begin, np.repeat(at, pieces), "right") - 1
    blank = (g & (_SPACE | _LINE)) > 0
    signs = lambda mask: np.bincount(seg[mask], minlength=m)
    held = signs(~blank)
    total = np.bincount(text, held, minlength=n)
    share = lambda mask: np.bincount(text[mask], held[mask], minlength=n) / np.maximum(total, 1)

    # Links and tags are taken out, but for what a tag shows to a reader.
    urls = [(x.start(), x.end(), x.group(1).lower()) for x in _URL.finditer(s)] if "//" in s else []
    linked = _cover(size, np.array([x[0] for x in urls], np.int64), np.array([x[1] for x in urls], np.int64))
    out = linked
    tags = [x.span() for x in _TAG.finditer(s)] if "<" in s else []
    if tags:
        tagged = _cover(size, np.array([x[0] for x in tags]), np.array([x[1] for x in tags]))
        shown = [x.span(1 if x.group(1) is not None else 2) for x in _SHOWN.finditer(s)]
        out = linked | (tagged & ~_cover(size, np.array([x[0] for x in shown], np.int64), np.array([x[1] for x in shown], np.int64)))

    # Signs of program text: brackets and operators, calls, ends of statements; not pointers such as >> -> =>.
    pv, nx, gv, gx = _back(p, 10), _on(p, 10), _back(g, _LINE), _on(g, _LINE)
    sign = (g & _SIGN) > 0
    at_sign = np.flatnonzero(sign | ((p < 128) & ~((g & (_WORD | _SPACE)) > 0)))
    c, a, b, ga, gb = p[at_sign], pv[at_sign], nx[at_sign], gv[at_sign], gx[at_sign]
    pointer = ((c == 62) & ((b == 62) | (a == 62) | (a == 45) | (a == 61))) | ((c == 61) & (b == 62))
    call = ((c == 40) | (c == 91)) & ((ga & _WORD) > 0) | (c == 40) & ((b == 34) | (b == 39) | ((gb & _DIGIT) > 0) & (((ga & _SPACE) > 0) | (a == 10)))
    other = (c == 59) & ((gb & _LINE) > 0) | (c == 36) & ((gb & _LETTER) > 0)
    other |= (c == 58) & ((a == 34) | (a == 58) | ((gb & _LINE) > 0) & (((ga & _WORD) > 0) | (a == 41)))
    sum_of = (c == 43) | (c == 42) | (c == 47) | (c == 37)  # between two terms
    other |= sum_of & (a == 32) & (b == 32) & ((g[np.maximum(at_sign - 2, 0)] & _WORD) > 0)
    coded = np.zeros(size, bool)
    coded[at_sign[(sign[at_sign] & ~pointer | call | other) & ~out[at_sign]]] = True
    n_sign = signs(coded)

    bare = _sites(s, p, g, fold, flags, ~out & ~(n_sign > 0)[seg])
    if bare:
        out = out | _cover(size, np.array([x[0] for x in bare]), np.array([x[1] for x in bare]))
    links = urls + bare
    link_at = np.array([x[0] for x in links], np.int64)
    numbers: dict[str, int] = {}
    host = _mix(np.array([numbers.setdefault(x[2], len(numbers)) for x in links], np.uint64))
    is_bare = np.arange(len(links)) >= len(urls)

    # Words.
    inside = ((g & _WORD) > 0) & ~out
    solid = ((g & _SOLID) > 0) & inside
    single = np.zeros(size, bool)
    if solid.any():
        x, y = np.flatnonzero(solid & ~_back(solid, False)), np.flatnonzero(solid & ~_on(solid, False)) + 1
        single = _cover(size, x[y - x > UNSPACED], y[y - x > UNSPACED])
    first = inside & (~_back(inside, False) | single | _back(single, False))
    start, w = np.flatnonzero(first), np.flatnonzero(inside)
    word = np.cumsum(first[w]) - 1
    k = len(start)
    value = np.zeros(k, np.uint64)
    count = np.bincount(word, minlength=k)
    letter = np.bincount(word[(g[w] & _LETTER) > 0], minlength=k)
    if k:
        value = np.add.reduceat(_mix(fold[w].astype(np.uint64) * _K + (w - start[word]).astype(np.uint64)), np.flatnonzero(first[w]))
    wseg = seg[start]
    wtext = text[wseg]
    real = letter > 0
    rseg, rtext, rvalue, rlen = wseg[real], wtext[real], value[real], count[real]
    n_word, n_number = np.bincount(rseg, minlength=m), np.bincount(wseg[~real], minlength=m)
    n_all = np.bincount(rtext, minlength=n)
    n_link = np.bincount(seg[link_at], minlength=m)

    # Kinds of lines.
    n_hash = signs((p == 35) & ((gx & _WORD) > 0) & ((gv & (_SPACE | _LINE)) > 0) & ~out)
    n_chunk = signs(~blank & ((gv & (_SPACE | _LINE)) > 0))
    n_part = signs(((g & _PART) > 0) & ~out)
    dot = np.flatnonzero(((g & _STOP) > 0) & ~out & ((gx & _WORD) == 0))
    dot = dot[((gv[dot] & _WORD) > 0) | np.isin(pv[dot], (41, 34, 39, 96))]
    after = g[np.minimum(dot + 2, size - 1)]
    dot = dot[~(((gx[dot] & (_SPACE | _LINE)) == _SPACE) & ((after & (_DIGIT | _LOWER)) > 0))]  # "art. 5" and "approx. so" end nothing
    n_stop = np.bincount(seg[dot], minlength=m)
    link_line = (n_link > 0) & (n_word <= PER_LINK * n_link) & ~((n_stop > n_link) & (n_word > 4 * n_link))
    tag_line = ~link_line & (n_hash >= 3) & (n_hash >= 0.7 * n_chunk)
    code_line = ~link_line & ~tag_line & (n_sign > 0) & (n_sign >= 0.2 * (n_word + n_number))
    sentence_line = ~link_line & ~tag_line & ~code_line & (n_word >= 4) & (n_stop > 0) & (n_word <= 40 * n_stop) & (4 * n_part <= n_word)
    phrase_line = ~link_line & ~tag_line & ~code_line & ~sentence_line & (n_word > 0)

    # Vocabulary of the lines that are neither code nor sentences.
    v = (link_line | tag_line | phrase_line)[rseg]
    vseg, vtext, vvalue = rseg[v], rtext[v], rvalue[v]
    n_voc = np.bincount(vtext, minlength=n)
    _, one, group, often = np.unique(_of(vvalue, vtext), return_index=True, return_inverse=True, return_counts=True)
    owner = vtext[one]
    n_type = np.bincount(owner, minlength=n)
    order = np.lexsort((-often, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], np.arange(n))[owner[order]]
    top = np.bincount(owner[order][rank < 12], often[order][rank < 12], minlength=n)
    repeated_line = phrase_line & (np.bincount(vseg[often[group] >= 3], minlength=m) >= 0.5 * n_word)
    near = vseg[1:] == vseg[:-1]
    pair = (_mix(vvalue[:-1]) * np.uint64(3) + vvalue[1:])[near]
    n_pair, pairs = np.bincount(vtext[1:][near], minlength=n), _distinct(pair, vtext[1:][near], n)

    # Sentences, and the longer word found in most of them.
    q = sentence_line[rseg]
    ends = np.searchsorted(dot, start[real][q])
    sentence = np.unique(rseg[q].astype(np.uint64) * np.uint64(1 << 32) + ends.astype(np.uint64), return_inverse=True)[1]
    n_sentence = np.zeros(n)
    refrain = np.zeros(n)
    if len(sentence):
        whose = np.zeros(int(sentence.max()) + 1, np.int64)
        whose[sentence] = rtext[q]
        n_sentence = np.bincount(whose, minlength=n)
        long = rlen[q] >= 4
        once = np.unique(_of(rvalue[q][long], sentence[long]), return_index=True)[1]
        refrain = np.where(n_sentence >= 6, _most(rvalue[q][long][once], rtext[q][long][once], n) / np.maximum(n_sentence, 1), 0)
    sentence_words = np.bincount(rtext[q], minlength=n) / np.maximum(n_sentence, 1)

    # Links.
    ltext = text[seg[link_at]]
    n_url = np.bincount(ltext, minlength=n)
    hosts = _distinct(host, ltext, n)
    variety = np.where(n_url > 0, 1 - _most(host, ltext, n) / np.maximum(n_url, 1), 0)  # without the most linked host

    # Lines that begin or end alike, or are of one shape, are made by or for a program.
    full = np.flatnonzero(held > 0)
    n_line = np.bincount(text[full], minlength=n)
    alike = lambda of: np.where(n_line >= FEW_LINES, of / np.maximum(n_line, 1), 0)
    begins, closes = np.full(m, -1), np.full(m, -1)
    begins[wseg[::-1]] = np.arange(k)[::-1]
    closes[wseg] = np.arange(k)
    same = lambda ends: alike(_most(value[ends[ends >= 0]], text[ends >= 0], n))
    kind = np.where((g & _WORD) > 0, np.where((g & _DIGIT) > 0, 2, 1), np.where(blank, 0, fold + 8)).astype(np.uint64)
    turn = np.flatnonzero(((kind != _back(kind, 0)) | (seg != _back(seg, -1))) & (kind > 0))
    tseg = seg[turn]
    head = np.flatnonzero(np.concatenate(([True], tseg[1:] != tseg[:-1]))) if len(turn) else turn
    place = np.arange(len(turn)) - np.repeat(head, np.diff(np.append(head, len(turn))))
    shape = np.zeros(m, np.uint64)
    if len(turn):
        shape[tseg[head]] = np.add.reduceat(_mix(kind[turn] * _K + place.astype(np.uint64)), head)
    marked = np.zeros(m, bool)
    marked[tseg[kind[turn] > 2]] = True
    uniform = _most(shape[marked], text[marked], n, held[marked]) / np.maximum(total, 1)

    # The text as a whole.
    rate = lambda x, of: x / np.maximum(of, 1)
    side = rtext[1:] == rtext[:-1]
    grams = _distinct((_mix(rvalue[:-1]) * np.uint64(3) + rvalue[1:])[side], rtext[1:][side], n)
    letters = np.flatnonzero(inside & ((g & _LETTER) > 0) & (p != 95))
    its = text[seg[letters]]
    six = np.flatnonzero(its[5:] == its[:-5]) if len(its) > 5 else np.empty(0, np.int64)
    run, f = np.zeros(len(six), np.uint64), fold[letters].astype(np.uint64)
    for i in range(6):
        run = run * _K + f[six + i]
    novelty = np.where(np.bincount(its[six], minlength=n) > 0, rate(_distinct(_mix(run), its[six], n), np.bincount(its[six], minlength=n)), 1.0)
    packed = np.array([len(zlib.compress(t, 1)) / max(1, len(t)) for t in (t.encode() for t in each)])
    return {
        "words": n_voc, "variety": rate(n_type, n_voc), "hapax": rate(np.bincount(owner[often == 1], minlength=n), n_voc), "permuted": rate(pairs, n_type), "top": rate(top, n_voc),
        "echo": np.where(n_pair > 0, 1 - rate(pairs, n_pair), 0), "phrases": share(phrase_line), "repeated": share(repeated_line), "tagged": share(tag_line), "links": share(link_line),
        "hosts": hosts, "host_variety": variety, "per_link": rate(np.bincount(text[link_line], n_word[link_line], minlength=n), n_url),
        "bare": rate(np.bincount(ltext[is_bare], minlength=n), n_url), "sentences": share(sentence_line), "sentence_count": n_sentence, "sentence_words": sentence_words, "refrain": refrain, "code": share(code_line),
        "digits": rate(np.bincount(text[seg[(g & _DIGIT) > 0]], minlength=n), total), "lead": same(begins), "uniform": np.where(n_line >= FEW_LINES, uniform, 0),
        "short": rate(np.bincount(rtext[rlen <= 3], minlength=n), n_all), "lists": rate(np.bincount(text, n_part, minlength=n), n_all),
        "s_size": total, "s_words": n_all, "s_packed": packed, "s_grams": rate(grams, _distinct(rvalue, rtext, n)), "s_novelty": novelty,
        "s_stops": rate(np.bincount(text, n_stop, minlength=n), n_all), "s_hosts": hosts, "s_urls": n_url, "s_symbols": rate(np.bincount(text, n_sign, minlength=n), n_all),
        "s_numerals": np.bincount(wtext[~real], minlength=n), "s_tail": same(closes),
    }


def measured(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Ranges of rows of a string column, and their values; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    s = 0
    while s < len(column):
        e = s + 1
        room = SLICE - length[s]
        while e < len(column) and length[e] <= room:
            room -= length[e]
            e += 1
        if length[s] <= WINDOW:
            yield s, e, measure(column.slice(s, e - s))
        else:
            whole = column[s].as_py()
            parts = [measure(pa.array([whole[i : i + WINDOW]], pa.large_string())) for i in range(0, len(whole), WINDOW)]
            weight = np.array([float(x["s_size"][0]) for x in parts])
            yield s, e, {c: np.array([sum(w * float(x[c][0]) for w, x in zip(weight, parts)) / max(1.0, weight.sum())]) for c in parts[0]}
        s = e
