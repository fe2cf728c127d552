"""PII (6): a linear-chain conditional random field over word-shape features.

Tokens are runs of letters, runs of digits and single marks.  A token's shape
(its kind, length class, a few cue words, whether it touches the token before)
is one small number, and the field scores the shapes from three tokens before
to three after, plus label transitions.  It is trained by gradient ascent, once
on the driver, on ``labelled()``: the marked sentences of ``LABELLED`` and those
that a rule makes of forms in surroundings; every third surrounding is held out
for measuring recall and precision.  Decoding is Viterbi in numpy batches.  Decoding is exact but skips tokens that no optimal path can label:
an upper bound on the gain of any labelled run through a token is a maximum-sum
run, and where that is not positive the token is outside.

Base patterns (email, ip, card, phone) are regexes whose failing matches are
dropped; the field adds spans that overlap none of them: numbers without a
country code, cards with other separators, addresses with *at* and *dot*.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; an empty table gives an empty result; other columns are not read.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(rb"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: The labelled table: sentences with their spans marked.
LABELLED = [
    "please call <phone>555-0142</phone> before noon", "my number is <phone>(312) 555-0199</phone> thanks", "tel <phone>(020) 7946 0018</phone>", "phone: <phone>415-555-0133</phone>",
    "reach us at <phone>212-555-0176</phone> or by mail", "fax <phone>(617) 555-0123</phone>.", "the office, <phone>305.555.0111</phone>, is open", "mobile <phone>07700 900123</phone>",
    "call <phone>+1 (202) 555-0147</phone> now", "write or ring <phone>+44 20 7946 0958</phone>", "Tel. <phone>+33 1 70 18 99 00</phone>", "ask for ana, <phone>(503) 555-0188</phone>, today",
    "<phone>(988) 555-2485</phone> is the new line", "rang <phone>702-555-0110</phone> twice", "Phone <phone>555-0107</phone>", "mobile: <phone>0151 23456789</phone>",
    "mail <email>ana.lee@example.com</email> today", "write to <email>j.doe42@mail.example.org</email>, please", "contact <email>help@example.net</email>", "from <email>x_y.77@mail8.example.com</email> to you",
    "email: <email>ana at example dot com</email>", "write to <email>bob dot ray at example dot org</email> soon", "mail me, <email>kim at mail dot example dot net</email>", "contact <email>info [at] example [dot] com</email>",
    "email <email>team (at) example (dot) org</email>", "reach <email>joe at example dot edu</email> for more", "<email>ops at example dot com</email>",
    "host <ip>10.20.30.40</ip> is down", "from <ip>192.0.2.17</ip> at night", "server <ip>198.51.100.7</ip>, port 80", "ip: <ip>203.0.113.99</ip>", "login by <ip>96.138.95.238</ip> failed", "the box <ip>28.68.191.238</ip> answers",
    "card <card>4111 1111 1111 1111</card> is valid", "visa <card>4012888888881881</card>", "pay with <card>5555-5555-5555-4444</card> now", "credit card: <card>378282246310005</card>", "card number <card>6011111111111117</card>.",
    # nothing to find
    "the meeting is at noon in room 12", "in 1998 there were 4,500 people", "version 2.0 of the license", "see pages 10-20 and 35-40", "it rose by 3.5 percent in 2021", "call me when you are home", "at the end of the day",
    "on 12/05/2020 we met", "chapter 4. section 2. part 1", "license 4.0 and later", "order 123456 was sent", "look at example one", "born 1975-04-12 in the town", "the phone is new", "an email came at last", "a card from ana",
    "temperatures of -5 to 30 degrees", "12:30 - 14:45 on monday", "they dot the map at night", "total: 1234567", "isbn 9780306406157", "ref no. 20190012 page 3", "model 300-200 or 500", "to be at peace, he said",
    "we live at sea", "the dot at the end", "one, two; three: four!", "The end. A new one. It was", "words | words | more | words", "###  *** $$$ %%% &&&", "lat 48.8566 lon 2.3522", "id 7 of 9", "v1.2.3 is out", "9 + 10 = 19", "(see 1999) and (2004)",
    "they sat at the table and ate, at ease, of that and more", "this is at work in the wild", "on the hill at home with them. At last it came", "was at first seen at the gate by a man", "that thing and this was at all times there",
    "at noon, at night, at dawn", "sit at, or by, the fire in one at a time", "la la at le en des et la at un une", "of at the in an on. The at is was it", "he ran at them, then at us", "people at large are at risk of it",
    "a man with a plan at hand for the end of it", "there are at least a few who at once left", "she came to be at one with it all.", "we look at it as an end at best", "En la de at y con. Los at el", "der die at und im, zu at", "shoe at size 9 or at 10",
    "here and there the long words run onward without end, and again", "Anat erin of the re, ounder at wh. Thinger or not", "Les mots de la fin sont au bord. Et puis", "und dann kam er an den ort, wo es war", "los que se van al mar no lo ven, y ya",
    "plain words, Plain Words, PLAIN WORDS, and some more", "one (two) three [four] five: six; seven", "He said. She said. They said at once.", "number one and number two", "the number of people", "a card game and a visa office", "host and server are down",
    "token = abc123def456", "password=531ccd051a92ebcb68 la", "a 4 b 5 c 6", "http://example.com/a/b", "AKIA7Q2 is 3 of 4",
]

#: What stands before and after a form; None: nothing that tells of it.
SURROUNDINGS = {
    "phone": [("call ", " now"), ("ring me at ", ""), ("tel ", ", please"), ("my number is ", "."), ("phone: ", " or mail"), ("mobile ", " after six"), ("fax (", ")"), ("reach the office at ", " on monday"), ("contact us, ", ", today"), ("text me on ", " when you can"), ("rang ", " twice"), ("the line ", " is open"), ("also ", ", evenings"), ("see you; ", ""), ("at ", " you find me"), ("or try ", " instead"), ("we are on ", " again"), ("(", ")")],
    "email": [("write to ", " soon"), ("mail ", ", please"), ("contact: ", ""), ("my address is ", "."), ("reach me, ", ", any time"), ("email <", ">"), ("send it to ", " and wait"), ("from ", " to all"), ("ask ", " for more"), ("questions? ", " has answers"), ("drop a line to ", " today"), ("sign up with ", ""), ("it is ", " still"), ("tell ", " about it"), ("or ", ", too"), ("see ", "; thanks")],
    "card": [("card ", " is valid"), ("visa ", " was charged"), ("pay with ", " now"), ("credit card: ", ""), ("card number ", "."), ("charge ", " for it"), ("my card, ", ", please"), ("use ", " to pay"), ("billed to ", " last week")],
    "ip": [("host ", " is down"), ("from ", " at night"), ("server ", ", port 80"), ("ip: ", ""), ("login by ", " failed"), ("the box ", " answers"), ("ip ", " was blocked"), ("ping ", " again"), ("seen at ", " twice")],
}
#: Forms: # a digit, 9 one of 2-9, a and b names, c a company, t a top domain; the rest stands for itself.
FORMS = {
    "phone": ["{9##-####}", "{(9##) 9##-####}", "{(9##) 9## ####}", "{9##-9##-####}", "{9##.9##.####}", "{9## 9## ####}", "{(0##) #### ####}", "{07### ######}", "{0### ########}", "{+# (9##) 9##-####}", "{1-9##-9##-####}"],
    "email": ["{a at c dot t}", "{a dot b at c dot t}", "{a(at)c.t}", "{a (at) c (dot) t}", "{a [at] c [dot] t}", "{a at c.t}", "{b at mail dot c dot t}", "{a.b@c.t}", "{a##@mail#.c.t}", "{a_b [at] c.t}"],
    "card": ["{luhn}", "{luhn4 }", "{luhn4-}", "{luhn4.}", "{luhn4/}"],
    "ip": ["{1##.##.#.1##}", "{10.#.#.##}", "{1##[.]##[.]#[.]##}"],
}
NAMES = "ana kim joe j lee maria thomas doe sales info jane petra webmaster o k ops rob".split()
COMPANIES = "example acme mailhost northwind uni big-shop site web posthaus".split()
TOPS = "com org net edu".split()
#: Sentences with nothing to find, of the same signs.
PLAIN = [
    "order ###### was sent", "on ##/##/20## we met", "born 19##-##-##", "open ##:## - ##:## daily", "it cost #,###.## in all", "pages ### - ###", "pages ###-### of it", "version #.#.## is out", "isbn 978#########", "ref no. ######## page #",
    "(##) of (###) items", "at ## and at ## degrees", "model ###-### or ###", "won #-# and #-#", "lat ##.#### lon #.####", "room ### at noon", "in 19## and (20##)", "total: #######", "id ################ is no account", "###### at ###### dot", "sum ## + ## = ###",
    "he is at home dot by dot", "at the example com and org", "the dot com boom", "look at a dot", "a b c d at e f g", "be at peace, he said", "she is at work in a net of lies", "mail came at ten", "call at noon", "phone at hand", "one at a time, dot", "meet (at) the gate", "see [at] below",
    "the end. A new one at last. It was so", "la la at le en des et", "und im at der die", "##.##.20## and ##.##.20##", "section #.#.#.# of the act", "chapter ##.#.#", "token = abc###def###", "a # b # c #", "zip ##### or #####-####", "#### words in #### lines", "#### #### ####", "row ### ### ###", "sku ####-####-###",
    "he sat at home. Then the rain came", "was seen at dawn. The man of the house", "a ernt at oninlynt. Edrend is so", "at an end. Onor it was", "of them at noon. He and she", "at first. Las casas at el mar. Un dia",
]


def labelled(held_out: bool = False, each: int = 4, seed: int = 7) -> list[str]:
    """Marked sentences by the rule: forms in the surroundings that are kept for training, or in those that are held out."""
    rng = np.random.default_rng(seed + held_out)
    digit = lambda c: str(rng.integers(2, 10) if c == "9" else rng.integers(0, 10)) if c in "#9" else c
    pick = lambda words: words[rng.integers(len(words))]

    def made(form: str) -> str:
        body = form[1:-1]
        if body.startswith("luhn"):
            n = [int(x) for x in "4" + "".join(str(x) for x in rng.integers(0, 10, 14))]
            n.append(-sum(n[1::2] + [d * 2 - 9 * (d > 4) for d in n[::2]]) % 10)
            text = "".join(map(str, n))
            return body[5:].join(text[i : i + 4] for i in range(0, 16, 4)) if len(body) > 4 else text
        if "#" in body and "@" not in body:
            return "".join(map(digit, body))
        words = {"a": lambda: pick(NAMES), "b": lambda: pick(NAMES), "c": lambda: pick(COMPANIES), "t": lambda: pick(TOPS)}
        return re.sub(r"(?<![a-z])[abct](?![a-z])|#", lambda m: digit("#") if m[0] == "#" else words[m[0]](), body)

    rows = [] if held_out else list(LABELLED)
    for kind, places in SURROUNDINGS.items():
        places = [x for i, x in enumerate(places) if (i % 3 == 0) == held_out]
        for form in FORMS[kind]:
            for _ in range(each):
                before, after = pick(places)
                filler = " ".join(pick(_FILLER) for _ in range(rng.integers(0, 5)))
                rows.append(f"{filler} {before}<{kind}>{made(form)}</{kind}>{after} {' '.join(pick(_FILLER) for _ in range(rng.integers(0, 5)))}".strip())
    for i, plain in enumerate(PLAIN):
        for _ in range(2):
            if (i % 3 == 0) == held_out or not held_out:
                rows.append(" ".join([pick(_FILLER), "".join(map(digit, plain)), pick(_FILLER)]))
    return rows


_FILLER = "the and words, more of it. Then en la que und so they saw; a thing here was not good at all, by".split()

_CUES = {"phone": 1, "tel": 1, "call": 1, "mobile": 1, "fax": 1, "ring": 1, "rang": 1, "number": 1, "card": 2, "visa": 2, "credit": 2, "ip": 3, "host": 3, "server": 3, "email": 4, "mail": 4, "contact": 4, "write": 4, "reach": 4, "at": 5, "dot": 6, "com": 7, "org": 7, "net": 7, "edu": 7}
_MARKS = "@.-+():/_,|[]"
_DIGITS = [1, 2, 3, 4, 5, 6, 8, 11, 15, 16, 19]  # last length of each class
N_WORD, N_CUE = 12, 8
N_SHAPES = 2 * (N_WORD + N_CUE + len(_DIGITS) + 1 + len(_MARKS) + 1)
EDGE = N_SHAPES  # beyond either end of a line
REACH = (-3, -2, -1, 0, 1, 2, 3)
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
NEVER = -1e4
ROUNDS, RATE, L2 = 250, 0.3, 0.02

_CLASS = np.full(256, 3, np.uint8)
_CLASS[tk.WHITE] = 0
_CLASS[tk.ALNUM_WORD] = 1
_CLASS[0x30:0x3A] = 2
_MARK = np.full(256, len(_MARKS), np.int64)
for _i, _c in enumerate(_MARKS):
    _MARK[ord(_c)] = _i
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    h = np.array([tk.span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), True)[0] for w in _CUES], np.uint64)
    order = np.argsort(h)
    return h[order], np.array(list(_CUES.values()), np.int64)[order]


_CUE_HASH, _CUE_KIND = _cue_table()


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a chunk: starts, ends, shape numbers, and whether a token opens a line (or document)."""
    kind = _CLASS[data]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    border = np.zeros(n + 1, bool)
    border[off] = True
    change = np.ones(n + 1, bool)
    change[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    change |= border
    starts = np.flatnonzero(change[:n] & (kind > 0))
    after = np.flatnonzero(change)
    ends = after[np.searchsorted(after, starts, "right")]
    k, size = kind[starts], ends - starts
    glued = np.zeros(len(starts), np.int64)
    glued[1:] = (starts[1:] == ends[:-1]) & ~border[starts[1:]]
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_upper = upper[ends] - upper[starts]
    case = np.where(n_upper == 0, 0, np.where(n_upper == size, 2, np.where((n_upper == 1) & _UPPER[data[starts]], 1, 3)))
    word = case * 3 + np.minimum((size > 2).astype(np.int64) + (size > 5), 2)
    letters = np.flatnonzero((k == 1) & (size <= 8))
    h = tk.span_hash(data, starts[letters], ends[letters], True)
    at = np.minimum(np.searchsorted(_CUE_HASH, h), len(_CUE_HASH) - 1)
    cue = np.flatnonzero(_CUE_HASH[at] == h)
    word[letters[cue]] = N_WORD + _CUE_KIND[at[cue]]
    number = N_WORD + N_CUE + np.searchsorted(_DIGITS, size)
    mark = N_WORD + N_CUE + len(_DIGITS) + 1 + _MARK[data[starts]]
    shape = 2 * np.where(k == 1, word, np.where(k == 2, number, mark)) + glued
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), bool)
    opens[1:] = lines[starts[1:]] != lines[starts[:-1]]
    doc = np.searchsorted(off, starts, "right")
    opens[1:] |= doc[1:] != doc[:-1]
    return starts, ends, shape, opens


def _around(shape: np.ndarray, opens: np.ndarray) -> list[np.ndarray]:
    """For each offset of REACH the shapes of the tokens there (EDGE beyond the line)."""
    line = np.cumsum(opens)
    out = []
    for o in REACH:
        x = np.full(len(shape), EDGE, np.int64)
        if o < 0:
            x[-o:] = np.where(line[-o:] == line[:o], shape[:o], EDGE)
        elif o > 0:
            x[:-o] = np.where(line[:-o] == line[o:], shape[o:], EDGE)
        else:
            x = shape.astype(np.int64)
        out.append(x)
    return out


def _allowed() -> np.ndarray:
    """Inside labels follow their own kind only."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            ok[:, j] = [x[1:] == label[1:] for x in LABELS]
    return ok


ALLOWED = _allowed()


def _marked(row: str) -> tuple[np.ndarray, list[tuple[str, int, int]]]:
    """A labelled row's bytes and spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"<(\w+)>(.*?)</\1>", row):
        text += row[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return np.frombuffer((text + row[at:]).encode(), np.uint8), spans


#: Weights are multiples of this, so that sums of them over any text are exact in 64 bits and do not depend on their order.
EXACT = 2.0**-20


@lru_cache(1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """(weights by offset, shape and label; transitions): penalised likelihood of the labelled table, all rows as one padded batch."""
    rows = []
    for row in labelled():
        data, spans = _marked(row)
        starts, ends, shape, opens = shapes(data, np.array([0, len(data)]))
        y = np.zeros(len(starts), np.int64)
        for kind, s, e in spans:
            inside = np.flatnonzero((starts >= s) & (ends <= e))
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[0]] = LABELS.index(f"B-{kind}")
        rows.append((_around(shape, opens), y))
    b, t, n = len(rows), max(len(y) for _, y in rows), len(LABELS)
    x = np.full((len(REACH), b, t), EDGE, np.int64)
    y, real = np.zeros((b, t), np.int64), np.zeros((b, t), bool)
    for i, (around, labels) in enumerate(rows):
        for o, a in enumerate(around):
            x[o, i, : len(a)] = a
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    weight, transition = np.zeros((len(REACH), EDGE + 1, n)), np.zeros((n, n))
    step_w, step_t = np.full_like(weight, 1e-8), np.full_like(transition, 1e-8)
    gold_w, gold_t = np.zeros_like(weight), np.zeros_like(transition)
    for o in range(len(REACH)):
        np.add.at(gold_w[o], (x[o][real], y[real]), 1)
    np.add.at(gold_t, (np.concatenate([np.zeros((b, 1), np.int64), y], 1)[:, :-1][real], y[real]), 1)
    last = real.sum(1) - 1
    np.add.at(gold_t, (y[np.arange(b), last], np.zeros(b, np.int64)), 1)
    for _ in range(ROUNDS):  # outside stands before and after every row
        tr = np.where(ALLOWED, np.exp(transition), 0.0)
        e = sum(weight[o][x[o]] for o in range(len(REACH)))
        e = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.empty((b, t, n)), np.empty((b, t, n))  # each scaled to the sum one, which changes no share below
        for i in range(t):
            new = (alpha[:, i - 1] @ tr if i else tr[None, 0]) * e[:, i]
            alpha[:, i] = np.where(real[:, i, None], new / new.sum(1, keepdims=True), alpha[:, i - 1])
        beta[:] = tr[:, 0] / tr[:, 0].sum()
        for i in range(t - 2, -1, -1):
            new = (e[:, i + 1] * beta[:, i + 1]) @ tr.T
            beta[:, i] = np.where(real[:, i + 1, None], new / new.sum(1, keepdims=True), beta[:, i])
        p = alpha * beta
        p *= real[:, :, None] / p.sum(2, keepdims=True)
        grad_w, grad_t = gold_w - L2 * weight, gold_t - L2 * transition
        for o in range(len(REACH)):
            for label in range(n):
                grad_w[o, :, label] -= np.bincount(x[o].ravel(), p[:, :, label].ravel(), EDGE + 1)
        grad_t[0] -= p[:, 0].sum(0)
        for i in range(1, t):
            left, right = alpha[:, i - 1], e[:, i] * beta[:, i]
            share = real[:, i] / np.einsum("bi,ij,bj->b", left, tr, right, optimize=True)
            grad_t -= tr * ((left * share[:, None]).T @ right)
        grad_t[:, 0] -= p[np.arange(b), last].sum(0)
        step_w += grad_w**2
        step_t += grad_t**2
        weight += RATE * grad_w / np.sqrt(step_w)
        transition += RATE * grad_t / np.sqrt(step_t)
    weight, transition = np.round(weight / EXACT) * EXACT, np.round(transition / EXACT) * EXACT
    return weight, np.where(ALLOWED, transition, NEVER)


LONG_RUN = 1024


def _blockwise(e: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best labels of one long run, all of its blocks step by step at once.

    A block's best scores from each label before it to each label at its end give, one block after the other, the true
    scores that enter each block; the usual steps within blocks start from those.  Scores are exact sums (EXACT), so the
    labels are those of the plain way, ties included."""
    n, labels = e.shape
    size = 1 << max(3, int(np.log2(n)) // 2 + 1)
    blocks = -(-n // size)
    padded = np.full((blocks * size, labels), NEVER, e.dtype)
    padded[:n], padded[n:, 0] = e, 0.0  # outside follows the run
    at = padded.reshape(blocks, size, labels)
    through = transition[None] + at[:, 0, None, :]
    for i in range(1, size):
        through = (through[:, :, :, None] + transition).max(2) + at[:, i, None, :]
    score = np.full((blocks, labels), -np.inf)
    score[0, 0] = 0.0
    for k in range(1, blocks):
        score[k] = (score[k - 1, :, None] + through[k - 1]).max(0)
    back = np.empty((size, blocks, labels), np.int8)
    for i in range(size):
        every = score[:, :, None] + transition
        back[i] = every.argmax(1)
        score = every.max(1) + at[:, i]
    rows = np.arange(blocks)
    origin = np.tile(np.arange(labels), (blocks, 1))  # of a block's last label: the label before the block
    for i in range(size - 1, -1, -1):
        origin = back[i][rows[:, None], origin]
    label = np.empty(blocks, np.int64)
    label[-1] = (score[-1] + transition[:, 0]).argmax()
    for k in range(blocks - 1, 0, -1):
        label[k - 1] = origin[k, label[k]]
    out = np.empty((blocks, size), np.int64)
    for i in range(size - 1, -1, -1):
        out[:, i] = label
        label = back[i][rows, label]
    return out.ravel()[:n]


def viterbi(emission: np.ndarray, begin: np.ndarray, size: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best labels of many runs of tokens (outside stands before and after each): all short runs step by step, the longest first, so that those that have ended cost nothing; long ones by blocks."""
    long = size > LONG_RUN
    if long.any():
        out = viterbi(emission, begin[~long], size[~long], transition)
        for b, n in zip(begin[long], size[long], strict=True):
            out[b : b + n] = _blockwise(emission[b : b + n], transition)
        return out
    if not len(begin):
        return np.zeros(len(emission), np.int64)
    out = np.zeros(len(emission), np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = int(size[0])
    going = np.searchsorted(-size, -np.arange(steps), "left")  # runs longer than each step
    score = transition[0] + emission[begin]
    back: list[np.ndarray] = []
    for i in range(1, steps):
        m = going[i]
        every = score[:m, :, None] + transition[None]
        best = every.argmax(1)
        back.append(best.astype(np.int8))
        score[:m] = np.take_along_axis(every, best[:, None, :], 1)[:, 0] + emission[begin[:m] + i]
    label = (score + transition[:, 0]).argmax(1)
    for i in range(steps - 1, -1, -1):
        m = going[i]
        out[begin[:m] + i] = label[:m]
        if i:
            label[:m] = back[i - 1][np.arange(m), label[:m]]
    return out


Field = tuple[np.ndarray, np.ndarray]


def decode(shape: np.ndarray, opens: np.ndarray, field: Field | None = None) -> np.ndarray:
    """The best label of every token by a field (by default that of this process)."""
    weight, transition = field or trained()
    n = len(shape)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    around = _around(shape, opens)
    gain_by = weight[:, :, 1:].max(2)  # an upper bound of a label's gain over outside, offset by offset
    gain = sum((gain_by[o] - weight[o, :, 0])[a] for o, a in enumerate(around))
    move = np.where(ALLOWED, transition, NEVER) - transition[0, 0]
    move[0, 0] = NEVER
    most = move.max()
    maybe = np.flatnonzero(_alive(gain + most, most, opens))
    if not len(maybe):
        return out
    # the same bound with the exact gains, now for few tokens
    e = sum(weight[o][a[maybe]] for o, a in enumerate(around))
    cut = np.concatenate([[True], (np.diff(maybe) > 1) | opens[maybe[1:]]])
    live = _alive((e[:, 1:].max(1) - e[:, 0]) + most, most, cut)
    at = np.flatnonzero(live)
    if not len(at):
        return out
    run = np.concatenate([[True], (np.diff(at) > 1) | cut[at[1:]]])
    begin = np.flatnonzero(run)
    size = np.diff(np.append(begin, len(at)))
    out[maybe[at]] = viterbi(e[at], begin, size, transition)
    return out


def _alive(gain: np.ndarray, most: float, opens: np.ndarray) -> np.ndarray:
    """Tokens in some run (within a line) whose summed gain plus one more transition is positive: two maximum-sum scans."""
    line = np.cumsum(opens)
    # lines are kept apart by a fall that no sum can make up for
    fall = -(np.abs(gain).sum() + abs(most) + 1.0) * 2

    def forward(g, opens_):
        total = np.cumsum(g + np.where(opens_, fall, 0.0))
        before = np.concatenate([[0.0], total[:-1]])
        base = np.where(opens_, before + fall, before)
        return total - np.minimum.accumulate(base)

    f = forward(gain, opens)
    closes = np.append(line[1:] != line[:-1], True)
    b = forward(gain[::-1], closes[::-1])[::-1]
    return f + b - gain + most > -1e-6


def _luhn(digits: bytes) -> bool:
    d = [c - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _valid(kind: str, match: bytes) -> bool:
    if kind == "ip":
        return all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in match.split(b"."))
    digits = bytes(c for c in match if 48 <= c < 58)
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


_LOCAL = bytes(c for c in range(128) if re.match(rb"[A-Za-z0-9._%+-]", bytes([c])))
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # no match begins or ends within a run of digits


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern, sign by sign: what is before a sign is read once, however long."""
    free = at = 0
    while (sign := text.find(b"@", at)) >= 0:
        before = text[max(free, at) : sign]
        local = len(before) - len(before.rstrip(_LOCAL))
        at = sign + 1
        if local and (m := _DOMAIN.match(text, at)):
            yield sign - local, m.end()
            free = at = m.end()


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in bytes: what finditer gives of the patterns, in time linear in the text."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if b"." in text:
        out += [(m.start(), 1, m.end()) for m in _QUAD.finditer(text) if _valid("ip", m[0])]
    out += [(m.start(), 2, m.end()) for m in PATTERNS["card"].finditer(text) if _valid("card", m[0])]
    if b"+" in text:
        out += [(m.start(), 3, m.end()) for m in PATTERNS["phone"].finditer(text) if _valid("phone", m[0])]
    return out


_DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)


_DOT = rb"(?:\.|\x20?[(\[]\x20?(?:dot|\.)\x20?[)\]]\x20?|\x20dot\x20)"
_ADDRESS = re.compile(rb"(?i)[a-z0-9_%+-]+(?:" + _DOT + rb"[a-z0-9_%+-]+)*(?:\x20?[(\[]\x20?(?:at|@)\x20?[)\]]\x20?|\x20(?:at|@)\x20|@)[a-z0-9-]+(?:" + _DOT + rb"[a-z0-9-]+)+")


def _sensible(kind: str, raw: bytes) -> bool:
    """What an added span must hold at least."""
    digits = bytes(c for c in raw if 48 <= c < 58)
    if kind == "email":
        return _ADDRESS.fullmatch(raw) is not None
    if kind == "ip":
        parts = re.findall(rb"[0-9]+", raw)
        return len(parts) == 4 and raw.count(b".") == 3 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def _trimmed(raw: bytes) -> tuple[int, int]:
    """Start and end of a span without stops at its ends and without a bracket that its other half is missing of."""
    s, e = 0, len(raw)
    while True:
        if e > s and raw[e - 1] in b".,;:?! -" or e > s and raw[e - 1] in b")]>" and raw.count(raw[e - 1 : e], s, e) > raw.count({41: b"(", 93: b"[", 62: b"<"}[raw[e - 1]], s, e):
            e -= 1
        elif s < e and raw[s] in b",;:!. -" or s < e and raw[s] in b"([<" and raw.count(raw[s : s + 1], s, e) > raw.count({40: b")", 91: b"]", 60: b">"}[raw[s]], s, e):
            s += 1
        else:
            return s, e


def find(column: pa.Array, field: Field | None = None) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Each row's base spans and added spans, (start, number of the kind, end) in code points."""
    for _, _, data, off in tk.chunks(column):
        n = len(off) - 1
        wanted = (tk.counts(data == 0x40, off) > 0) | (tk.counts(_DIGIT[data], off) >= 4)
        base = {int(d): base_spans(data[off[d] : off[d + 1]].tobytes()) for d in np.flatnonzero(wanted)}
        starts, ends, shape, opens = shapes(data, off)
        label = decode(shape, opens, field)
        added: dict[int, list[tuple[int, int, int]]] = {}
        first = np.flatnonzero(label % 2 == 1)
        for i in first:
            j = i + 1
            while j < len(label) and label[j] == label[i] + 1 and not opens[j]:
                j += 1
            d = int(np.searchsorted(off, starts[i], "right")) - 1
            raw = data[starts[i] : ends[j - 1]].tobytes()
            left, right = _trimmed(raw)
            s, e, k = int(starts[i] - off[d]) + left, int(starts[i] - off[d]) + right, (int(label[i]) - 1) // 2
            if _sensible(KINDS[k], raw[left:right]) and all(e <= x[0] or s >= x[2] for x in base.get(d, ())):
                added.setdefault(d, []).append((s, k, e))
        for d in range(n):
            if not base.get(d) and d not in added:
                yield [], []
                continue
            point = np.concatenate([[0], np.cumsum(tk.NOT_CONT[data[off[d] : off[d + 1]]])])
            yield tuple(sorted((int(point[s]), k, int(point[e])) for s, k, e in spans) for spans in (base.get(d, []), added.get(d, [])))


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, n_added bigint"


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's base counts and digest, all spans, their number and that of those the field added."""
    field = docs.sparkSession.sparkContext.broadcast(trained())  # a few hundred kilobytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[sum(x[1] == k for x in base) for k in range(len(KINDS))] + [hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(base) + len(added), len(added)] for base, added in find(batch.column(1), field.value)]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:6]), *(pa.array(c, pa.int64()) for c in columns[6:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"])

    tk.modest_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows, columns unchanged, each span replaced by its kind in brackets."""
    position, schema = docs.columns.index(text_col), docs.schema
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position).to_pylist()
            for i, (base, added) in enumerate(find(batch.column(position), field.value)):
                low = len(texts[i]) if texts[i] is not None else 0
                for s, k, e in sorted(base + added, reverse=True):
                    if e <= low:
                        texts[i] = f"{texts[i][:s]}[{KINDS[k]}]{texts[i][e:]}"
                        low = s
            yield batch.set_column(position, batch.schema.field(position), pa.array(texts, batch.schema.field(position).type))

    tk.modest_batches(docs)
    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(text: str | None) -> str:
    """The base spans the plain way, for tests."""
    raw = (text or "").encode()
    return listed([(len(raw[:m.start()].decode()), k, len(raw[: m.end()].decode())) for k, kind in enumerate(KINDS) for m in PATTERNS[kind].finditer(raw) if _valid(kind, m[0])])
