"""Abusive, hateful or sexual content: boosted trees over dense sentence features, calibrated.

A text is normalised (invisible characters out, compatibility forms, look-alike letters, digits and signs
for letters, masked, spaced and stretched spellings), split into sentences, and every sentence counted by
lexicon.  A document's features are the worst sentence's counts and combinations, and whole-text
densities, so that one passage in a long document shows whatever surrounds it.

The model is fitted on human labels: at most ``SAMPLE`` labelled documents, chosen by hash of doc_id.
From them a second lexicon is learned: phrases of up to ``GRAM_WORDS`` words that stand in at least
``GRAM_DOCUMENTS`` documents called abusive, near copies counted once, and are much likelier there than elsewhere.  The trees see what
these phrases say of documents that had no part in learning them.  Isotonic calibration uses out-of-fold
scores.  Scoring reads every document once, without a shuffle; a sentence seen before is looked up.

Defined results
---------------
* Null, empty and blank texts score 0.  The whole text counts, never a prefix.
* Several raters of one document are averaged; null votes and repeated label rows do not count.
* Hand-written examples (``SEED_*``) stand beside the labels, so a small label table gives a usable model;
  without any label every score is 0 and nothing is flagged.
* Several texts of one doc_id: flagged if one of them is; the score is the highest.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from re import _constants as sre, _parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.abuse_words import CJK, PHRASES, SEED_ABUSIVE, SEED_PLAIN, WORDS
from lodegraph.llm.boosting import BoostedTrees, Isotonic
from lodegraph.session import cut_lineage

#: Bound of the labelled documents that the model is fitted on.
SAMPLE = 40_000
FOLDS = 4
THRESHOLD = 0.5

CATEGORIES = list(WORDS)
_STRONG = ("vulgar", "insult", "dehuman", "threat", "selfharm", "body", "sexact", "contempt", "group")
#: Learned phrases: their longest, the abusive documents that hold one at least, the log-odds from which it counts.
GRAM_WORDS, GRAM_DOCUMENTS, GRAM_ODDS = 4, 3, 3.0
#: Bounds of the candidates for phrases, the most frequent first, and of the remembered sentences (in characters).
MAX_GRAMS, MEMORY_CHARS = 100_000, 16_000_000

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans(
    "аеорсухіѕјһԁԛԝкмтвнзгьАВЕКМНОРСТУХІЅЈαεορντυικχγ",
    "aeopcyxisjhdqwkmtbhзгьABEKMHOPCTYXISJaeopvtuikxy",
)
_LOOKALIKE_ONLY = re.compile(r"[аеорсухіѕјһԁԛԝαορνι]+")
#: In every text with a word of Latin and look-alike letters.
_MIXED_HINT = re.compile("[{0}][^\\W_]*[a-zA-Z]|[a-zA-Z][^\\W_]*[{0}]".format("".join(map(chr, _LOOKALIKE))))
_DIGIT_LETTERS = str.maketrans("013457@$!|8", "oieastasilb")
_SENTENCE = re.compile(r"[.!?;:]+(?=\s|$)|[。！？；\n]|\*/|/\*|\"\"\"")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_MASKED = re.compile(r"(?<![\w*+/=])([^\W\d_]+)([*#%@]{1,6})([^\W\d_]+)(?![\w*+/=])")
#: In every text in which ``_SIGNED`` matches.
_SIGN_HINT = re.compile(r"[@$!|][\w@$!|]|\w[@$!|]")
_SIGNED = re.compile(r"(?<![\w+/=@$!|])(?=[^\W_]*[@$!|])[^\W_]?[\w@$!|]{2,15}(?![\w+/=])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_MASK_HINT = re.compile(r"[*#%@][^\W\d_]")
_FOREIGN_WORD = re.compile(r"[^\W_]*[^\x00-\x7f\W_][^\W_]*")
_SHOUT = re.compile(r"(?:\b[A-Z]{2,}\b[ ,.!']*){4,}")
_SHOUT_HINT = re.compile(r"[A-Z]{2}[ ,.!']+[A-Z]{2}")
_HAS_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")


def _build():
    exact: dict[str, int] = {}
    starts: dict[str, int] = {}
    for k, text in enumerate(WORDS.values()):
        for w in text.split():
            if w.endswith("*"):
                starts[w[:-1]] = starts.get(w[:-1], 0) | 1 << k
            else:
                exact[w] = exact.get(w, 0) | 1 << k
    return exact, starts


_EXACT, _STARTS = _build()
_START_LENGTHS = sorted({len(s) for s in _STARTS})
_PHRASES = {k: re.compile(r"\b(?:" + "|".join(f"(?:{p})" for p in v) + ")") for k, v in PHRASES.items()}
_CJK = {k: v.split() for k, v in CJK.items()}
#: Words that are in so many sentences that a phrase is recognised by another of its words, where it has one.
_COMMON = set("a an the i we you your it is are be been to in of on at for so do not my me him her his he she they them no one all have has will would can how this that with from get make see like use when and or let by".split())


def _literals(parsed, bounded: bool) -> list[str] | None:
    """Patterns of single words (or parts) of which every match of a parsed phrase holds at least one.

    None if there is no such list; of several lists the one of rarer words.  ``bounded``: a word begins here.
    """
    lists: list[list[str]] = []
    run, starts = "", bounded

    def end(at_border: bool):
        nonlocal run
        if run:
            lists.append([(r"\b" if starts else "") + re.escape(run) + (r"\b" if at_border else "")])
        run = ""

    for op, value in parsed:
        if op is sre.LITERAL and chr(value) != " ":
            run += chr(value)
            continue
        border = op is sre.LITERAL or op is sre.AT and value in (sre.AT_END, sre.AT_BOUNDARY)
        begins = not run and starts
        end(border)
        whole_words = op is sre.MAX_REPEAT and value[2][-1] == (sre.LITERAL, ord(" "))
        starts = border or begins and whole_words
        if op is sre.SUBPATTERN:
            lists.append(_literals(value[-1], begins))
        elif op is sre.MAX_REPEAT and value[0] > 0:
            lists.append(_literals(value[2], begins))
        elif op is sre.BRANCH:
            each = [_literals(b, begins) for b in value[1]]
            lists.append(None if None in each else [x for e in each for x in e])
    end(False)
    bare = lambda x: x.replace(r"\b", "").replace("\\", "")
    return min(filter(None, lists), key=lambda e: sum(100 * (bare(x) in _COMMON or len(bare(x)) < 3) + 1 / len(bare(x)) for x in e), default=None)


def _anchor(phrase: str) -> re.Pattern:
    """What one word of every sentence with the phrase holds; any word, if that cannot be told."""
    return re.compile("|".join(_literals(sre_parser.parse(phrase), True) or [""]))


#: (number of the kind, phrase, its anchor)
_EACH_PHRASE = [(k, re.compile(rf"\b(?:{p})"), _anchor(p)) for k, v in enumerate(PHRASES.values()) for p in v]
_SINGLE = list(dict.fromkeys(x for _, _, a in _EACH_PHRASE for x in a.pattern.split("|")))
_ANY_ANCHOR = re.compile("|".join([r"\b(?:" + "|".join(x[2:] for x in _SINGLE if x[:2] == r"\b") + ")", *(x for x in _SINGLE if x[:2] != r"\b")]))
_ANCHOR_BIT = 1 << len(CATEGORIES)


@lru_cache(200_000)
def _phrases_with(word: str) -> tuple[tuple[int, re.Pattern], ...]:
    """(number of the kind, phrase) of the phrases that the word may be part of by their anchors."""
    return tuple((k, p) for k, p, a in _EACH_PHRASE if a.search(word)) if _ANY_ANCHOR.search(word) else ()


def phrase_counts(words: list[str], found: list[int]) -> list[int]:
    """How often each kind of phrase occurs in a sentence; exact, the anchors only choose what is looked for."""
    counts, joined = [0] * len(_PHRASES), " ".join(words)
    kinds = list(_PHRASES.values())
    for word, bits in zip(words, found, strict=True):
        if bits & _ANCHOR_BIT:
            for k, phrase in _phrases_with(word):
                if not counts[k] and phrase.search(joined):
                    counts[k] = len(kinds[k].findall(joined))
    return counts


_SEVERE = {c: 1 << CATEGORIES.index(c) for c in CATEGORIES}
_ABUSIVE = sum(_SEVERE[c] for c in ("vulgar", "insult", "body", "sexact", "threat", "selfharm", "dehuman"))
_HARD = [w.rstrip("*") for c in ("vulgar", "insult", "body") for w in WORDS[c].split() if len(w.rstrip("*")) >= 3]
_BY_SHAPE: dict[tuple[str, str, int], list[str]] = {}
for _w in dict.fromkeys(["fuck", "kill", "suck", "lick", "screw", "strip", *_HARD, "vermin", "filth", "trash", "animals", "plague", "fucking", "retards", "idiots", "morons"]):
    _BY_SHAPE.setdefault((_w[0], _w[-1], len(_w)), []).append(_w)
_HARD_SET = set(_HARD) | {"kill", "suck", "lick", "screw", "strip", "vermin", "filth", "trash", "animals", "plague"}

def bits_of(word: str) -> int:
    """Categories of a word in plain spelling, one bit each."""
    got = _EXACT.get(word, 0)
    for n in _START_LENGTHS:
        if n > len(word):
            break
        got |= _STARTS.get(word[:n], 0)
    if not got and word.endswith(("'s", "’s")):
        got = bits_of(word[:-2])
    return got


def _hard(word: str) -> bool:
    return word in _HARD_SET or bool(bits_of(word) & _ABUSIVE and len(word) > 3)


def normalised(text: str) -> tuple[str, int]:
    """The text in plain spelling, lower case, and how many disguised abusive words were found."""
    disguised = 0
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        mixed = False

        def plain(m):
            nonlocal mixed
            w = m[0]
            if not w.isascii() and any("a" <= c <= "z" or "A" <= c <= "Z" for c in w):
                t = w.translate(_LOOKALIKE)
                if t.isascii():
                    mixed = True
                    return t
            return w

        if _MIXED_HINT.search(text):
            text = _FOREIGN_WORD.sub(plain, text)
        if mixed:
            disguised += 1
            text = _FOREIGN_WORD.sub(lambda m: m[0].lower().translate(_LOOKALIKE) if _LOOKALIKE_ONLY.fullmatch(m[0].lower()) else m[0], text)
    text = text.lower()

    def masked(m):
        nonlocal disguised
        a, stars, b = m.groups()
        for extra in (0, 1, -1, 2):
            n = len(a) + len(stars) + len(b) + extra
            for w in _BY_SHAPE.get((a[0], b[-1], n), ()):
                if w.startswith(a) and w.endswith(b):
                    disguised += 1
                    return w
        return m[0]

    if any(map(text.__contains__, "*#%@")) and _MASK_HINT.search(text):
        text = _MASKED.sub(masked, text)
    if any(map(text.__contains__, "@$!|")) and _SIGN_HINT.search(text):

        def signs(m):
            nonlocal disguised
            word = m[0].rstrip("!|")  # behind a word they may be only marks
            plain, marks = _from_signs(word), m[0][len(word) :]
            if plain is None:
                plain, marks = _from_signs(m[0]), ""
            if plain is None or plain == word:
                return m[0]
            disguised += 1
            return plain + marks

        text = _SIGNED.sub(signs, text)
    return text, disguised


def _from_signs(word: str) -> str | None:
    """The abusive word that digits and signs stand for."""
    if len(word) < 3:
        return None
    for t in (word.translate(_DIGIT_LETTERS), word.replace("1", "l").translate(_DIGIT_LETTERS)):
        if t.isalpha() and _hard(t):
            return t
    return None


def _from_letters(letters: str) -> list[str] | None:
    """Spaced letters as words: an abusive word, with at most two single letters before it."""
    for cut in range(min(3, len(letters) - 2)):
        if letters[cut:] in _HARD_SET or (len(letters) - cut > 4 and _hard(letters[cut:])):
            return [*letters[:cut], letters[cut:]]
    return None


def _plain(word: str) -> list[str] | None:
    """What a single disguised word says: spaced by hyphens, stretched, or spelled with digits."""
    parts = word.split("-")
    if len(parts) > 2 and all(len(p) == 1 for p in parts):
        return _from_letters("".join(parts))
    if not word.isalpha():
        found = _from_signs(word)
        if found:
            return [found]
    if _STRETCHED.search(word):
        for t in (_STRETCHED.sub(r"\1", word), _STRETCHED.sub(r"\1\1", word)):
            if _hard(t):
                return [t]
    return None


#: word -> (categories and _ANCHOR_BIT, plain words if it is a disguise); only a cache, results do not depend on it
_memo: dict[str, tuple[int, list[str] | None]] = {}


def _look(word: str) -> tuple[int, list[str] | None]:
    got = _memo.get(word)
    if got is None:
        bits = bits_of(word)
        got = (bits | _ANCHOR_BIT if _ANY_ANCHOR.search(word) else bits, None if bits else _plain(word))
        if len(_memo) > 200_000:
            _memo.clear()
        _memo[word] = got
    return got


def plain_words(words: list[str]) -> tuple[list[str], list[int], int]:
    """Words of a sentence in plain spelling, their bits (categories, ``_ANCHOR_BIT``), and how many disguises were undone."""
    looked = [_look(w) for w in words]
    disguised = 0
    if any(p for _, p in looked):
        out: list[str] = []
        for w, (_, p) in zip(words, looked, strict=True):
            out += p or [w]
            disguised += p is not None
        words, looked = out, [_look(w) for w in out]
    if sum(len(w) == 1 for w in words) > 2:
        out, run = [], []
        for w in [*words, ""]:
            if len(w) == 1 and w.isalpha():
                run.append(w)
                continue
            found = _from_letters("".join(run)) if len(run) > 2 else None
            disguised += found is not None
            out += found or run
            run = []
            out += [w] if w else []
        if out != words:
            words, looked = out, [_look(w) for w in out]
    return words, [b for b, _ in looked], disguised


def undisguised(text: str) -> tuple[str, int]:
    """A whole text in plain spelling, sentence by sentence, and how many disguises were undone."""
    plain, n = normalised(text)
    out = []
    for sentence in _SENTENCE.split(plain):
        words, _, k = plain_words(_WORD.findall(sentence))
        out.append(" ".join(words))
        n += k
    return ". ".join(out), n


PHRASE_KINDS = list(PHRASES)
_COMBOS = [
    ("vulgar", "second"), ("insult", "second"), ("insult", "person"), ("threat", "second"), ("selfharm", "second"), ("group", "dehuman"),
    ("body", "sexact"), ("body", "second"), ("sexact", "second"), ("contempt", "second"), ("contempt", "group"), ("vulgar", "insult"),
    ("insult", "thing"), ("vulgar", "thing"), ("group", "mention"),
]
_TELLING_COMBOS = 12
BASE_FEATURES = (
    [f"max_{c}" for c in CATEGORIES] + [f"max_{p}" for p in PHRASE_KINDS] + [f"both_{a}_{b}" for a, b in _COMBOS]
    + [f"density_{c}" for c in _STRONG] + ["near_second", "phrase_total", "phrase_second", "worst", "disguised", "shouted", "exclaimed", "marks", "sentences", "cjk_abuse"]
)
LEARNED_FEATURES = ["learned_sum", "learned_best", "learned_count", "learned_second"]
FEATURES = BASE_FEATURES + LEARNED_FEATURES
N_FEATURES = len(FEATURES)
_N_CAT, _SECOND, _PERSON = len(CATEGORIES), CATEGORIES.index("second"), CATEGORIES.index("person")
_COMBO_INDEX = [(CATEGORIES.index(a), CATEGORIES.index(b)) for a, b in _COMBOS]
_THING, _MENTION = CATEGORIES.index("thing"), CATEGORIES.index("mention")
_TELLING = _ANCHOR_BIT | sum(1 << CATEGORIES.index(c) for c in _STRONG)
_DIRECTED = 1 << _SECOND | 1 << _PERSON


def units(words: list[str]) -> list[str]:
    """What learned phrases consist of: words, and the single characters of scripts without blanks."""
    if not any(len(w) > 1 and _HAS_CJK.search(w) for w in words if not w.isascii()):
        return words
    return [u for w in words for u in (w if _HAS_CJK.search(w) else [w])]


def grams_of(words: list[str]) -> set[str]:
    """All phrases of a sentence."""
    u = units(words)
    return {" ".join(u[i : i + n]) for i in range(len(u)) for n in range(1, min(GRAM_WORDS, len(u) - i) + 1)}


#: Flags of a word besides its categories: it may be a disguise, is a single letter, belongs to a learned phrase, is of a script without blanks.
_DISGUISE, _LETTER, _LEARNED, _NO_BLANKS = (_ANCHOR_BIT << k for k in range(1, 5))
_WORTH_READING = _TELLING | _DISGUISE | _LEARNED | _NO_BLANKS


class _Bits(dict):
    """word -> its categories and flags; only a cache."""

    def __init__(self, keys):
        self.keys_of_phrases = keys

    def __missing__(self, word: str) -> int:
        bits, plain = _look(word)
        if plain:
            bits |= _DISGUISE
        if len(word) == 1:
            bits |= _LETTER
        if word in self.keys_of_phrases:
            bits |= _LEARNED
        if not word.isascii() and _HAS_CJK.search(word):
            bits |= _NO_BLANKS
        if len(self) > 200_000:
            self.clear()
        self[word] = bits
        return bits


class Reader:
    """Reads texts sentence by sentence, with a numbered list of learned phrases; equal sentences are read once."""

    def __init__(self, grams: list[str] = ()):
        self.number = {g: k for k, g in enumerate(grams)}
        places: dict[str, set[tuple[int, int]]] = {}
        for g in grams:
            words = g.split(" ")
            key = max(words, key=lambda w: (w not in _COMMON, len(w), w))  # the word that is probably the rarest
            places.setdefault(key, set()).add((words.index(key), len(words)))
        #: word -> where phrases begin that it is the key of, and how long they are
        self.places = {w: sorted(p) for w, p in places.items()}
        self.bits = _Bits(self.places)
        self.memo: dict[str, tuple] = {}
        self.chars = 0

    def learned(self, words: list[str]) -> tuple[int, ...]:
        """Numbers of the learned phrases in a sentence, each once."""
        u, found = units(words), []
        for i, w in enumerate(u):
            for before, n in self.places.get(w, ()):
                at = i - before
                if at >= 0 and at + n <= len(u):
                    k = self.number.get(" ".join(u[at : at + n]) if n > 1 else w)
                    if k is not None:
                        found.append(k)
        return tuple(dict.fromkeys(found))

    def plain(self, text: str) -> tuple[list[str], list[int], int, int]:
        """Words of a normalised sentence in plain spelling, their bits, all bits together, and how many disguises were undone."""
        words = _WORD.findall(text)
        found = list(map(self.bits.__getitem__, words))
        union = reduce(or_, found, 0)
        undone = 0
        if union & _DISGUISE or union & _LETTER and sum(1 for b in found if b & _LETTER) > 2:
            words, _, undone = plain_words(words)
            found = list(map(self.bits.__getitem__, words))
            union = reduce(or_, found, 0)
        return words, found, union, undone

    def sentence(self, text: str) -> tuple | int:
        """(words, disguises, what it tells) of a normalised sentence; only the number of words if it tells nothing."""
        got = self.memo.get(text)
        if got is None:
            got = self._sentence(text)
            if got[2] is None and not got[1]:
                got = got[0]
            self.chars += len(text)
            if self.chars > MEMORY_CHARS:
                self.memo, self.chars = {}, len(text)
            self.memo[text] = got
        return got

    def _sentence(self, text: str) -> tuple:
        words, found, union, undone = self.plain(text)
        n_words = len(words)
        if not union & _WORTH_READING:
            return n_words, undone, None
        has_cjk = union & _NO_BLANKS
        grams = self.learned(words) if union & (_LEARNED | _NO_BLANKS) else ()
        if not has_cjk and not union & _TELLING and not grams:
            return n_words, undone, None
        counts, bad_at, you_at = [0] * _N_CAT, [], []
        for i, bits in enumerate(found):
            bits &= _ANCHOR_BIT - 1
            if bits & _ABUSIVE:
                bad_at.append(i)
            if bits >> _SECOND & 1:
                you_at.append(i)
            while bits:
                low = bits & -bits
                counts[low.bit_length() - 1] += 1
                bits ^= low
        near, cjk = 0.0, 0
        if has_cjk:
            for k, words_of in _CJK.items():
                hits = sum(text.count(w) for w in words_of)
                counts[CATEGORIES.index(k)] += hits
                cjk += hits * (k != "second")
            if counts[_SECOND] and (counts[0] or counts[1]):
                near = 1.0
        phrases = phrase_counts(words, found) if union & _ANCHOR_BIT else [0] * len(PHRASE_KINDS)
        if bad_at and you_at:
            near = max(near, 1.0 / (1 + min(abs(a - b) for a in bad_at for b in you_at)))
        if not any(phrases) and not grams and not any(counts):
            return n_words, undone, None
        n_phrases = sum(map(bool, phrases))
        combos = [min(counts[a], counts[b]) for a, b in _COMBO_INDEX]
        score = 3 * n_phrases + 2 * counts[0] + counts[1] + sum(map(bool, combos[:_TELLING_COMBOS]))
        if not n_phrases:
            score -= 2 * counts[_MENTION] + counts[_THING]
        return n_words, undone, (counts, phrases, combos, near, n_phrases, bool(you_at) or counts[_SECOND] > 0, score, cjk, grams, bool(union & _DIRECTED))

    def sentences(self, text: str) -> tuple[list[tuple | int], int]:
        plain, disguised = normalised(text)
        return list(map(self.sentence, _SENTENCE.split(plain))), disguised

    def read(self, text: str | None) -> tuple[np.ndarray, list[tuple[tuple[int, ...], bool]]]:
        """The base features of one whole text, and per sentence its learned phrases and whether it speaks of somebody."""
        out = np.zeros(len(BASE_FEATURES), np.float32)
        if not text or not text.strip():
            return out, []
        sentences, disguised = self.sentences(text)
        n_ph = len(PHRASE_KINDS)
        tops = [0] * (_N_CAT + n_ph + len(_COMBOS))
        total = [0] * _N_CAT
        nearest, phrase_total, phrase_second, worst, n_words, n_sentences, cjk = 0.0, 0, 0, 0.0, 0, 0, 0
        hits = []
        for got in sentences:
            if got.__class__ is int:
                n_words += got
                n_sentences += got > 0
                continue
            words, undone, told = got
            n_sentences += 1
            n_words += words
            disguised += undone
            if told is None:
                continue
            counts, phrases, combos, near, n_phrases, you, score, foreign, grams, directed = told
            nearest, worst = max(nearest, near), max(worst, score)
            phrase_total += n_phrases
            cjk += foreign
            if you:
                phrase_second = max(phrase_second, n_phrases)
            tops = list(map(max, tops, counts + phrases + combos))
            total = [a + b for a, b in zip(total, counts, strict=True)]
            if grams:
                hits.append((grams, directed))
        shouted = sum(map(len, _SHOUT.findall(text))) if _SHOUT_HINT.search(text) else 0
        out[: len(tops)] = tops
        out[len(tops) :] = (
            *(100.0 * total[CATEGORIES.index(c)] / max(1, n_words) for c in _STRONG),
            nearest, phrase_total, phrase_second, worst, disguised, shouted / max(1, len(text)), text.count("!") / max(1, n_sentences),
            sum(map(text.count, "*@$#")) / max(1, len(text)), np.log1p(n_sentences), cjk,
        )
        return out, hits


def learned_features(hits: list[tuple[tuple[int, ...], bool]], odds: np.ndarray) -> tuple[float, float, int, float]:
    """Of the sentence that the learned phrases speak most against: their sum, the strongest, how many, and the sum beside a person."""
    most = best = directed_most = 0.0
    count = 0
    for grams, directed in hits:
        scores = [odds[g] for g in grams if odds[g] > 0]
        if scores:
            total = sum(scores)
            most, best, count = max(most, total), max(best, *scores), max(count, len(scores))
            if directed:
                directed_most = max(directed_most, total)
    return most, best, count, directed_most


def features(text: str | None, reader: Reader | None = None, odds: np.ndarray = np.zeros(0)) -> np.ndarray:
    """The dense feature vector of one whole text."""
    base, hits = (reader or Reader()).read(text)
    return np.concatenate([base, np.array(learned_features(hits, odds), np.float32)])


def feature_matrix(texts, reader: Reader | None = None, odds: np.ndarray = np.zeros(0)) -> np.ndarray:
    reader = reader or Reader()
    rows = [features(t, reader, odds) for t in texts]
    return np.stack(rows) if rows else np.zeros((0, N_FEATURES), np.float32)


def log_odds(positive: np.ndarray, negative: np.ndarray, n_positive: float, n_negative: float, least: int = GRAM_DOCUMENTS) -> np.ndarray:
    """How much likelier a phrase is in abusive documents than in others; 0 where that is too little or known from too few."""
    odds = np.log((positive + 0.5) / (n_positive + 1)) - np.log((negative + 0.5) / (n_negative + 1))
    return np.where((positive >= least) & (odds >= GRAM_ODDS), odds, 0.0)


@dataclass
class AbuseModel:
    trees: BoostedTrees | None
    calibration: Isotonic | None
    threshold: float
    grams: list[str] = field(default_factory=list)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.where(x.any(1), np.clip(self.calibration(self.trees.decision(x)), 0.0, 1.0), 0.0)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grams: list[str] = (), odds: np.ndarray = np.zeros(0)) -> AbuseModel:
    """Trees on all rows, calibration on scores of folds that had no part in their own model."""
    if not len(y):
        return AbuseModel(None, None, THRESHOLD)
    bad, plain = (re.split(r"[|\n]", t.strip()) for t in (SEED_ABUSIVE, SEED_PLAIN))
    x = np.concatenate([x, feature_matrix(bad + plain)])
    y = np.concatenate([y, np.ones(len(bad)), np.zeros(len(plain))])
    weight = np.concatenate([weight, np.ones(len(bad) + len(plain))])
    fold = np.random.default_rng(11).permutation(len(y)) % FOLDS
    held = np.zeros(len(y))
    for k in range(FOLDS):
        mine = fold == k
        held[mine] = BoostedTrees().fit(x[~mine], y[~mine], weight[~mine]).decision(x[mine])
    return AbuseModel(BoostedTrees().fit(x, y, weight), Isotonic.fit(held, y, weight), THRESHOLD, list(grams), odds)


def votes(labels: DataFrame) -> DataFrame:
    """(doc_id, y, n): the mean vote of each labelled document."""
    single = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id", "rater", "labelled_at").agg(
        F.max(F.col("toxic").cast("double")).alias("toxic")
    )
    return single.groupBy("doc_id").agg(F.avg("toxic").alias("y"), F.count(F.lit(1)).alias("n"))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each phrase of each document, once, with the smallest hash of a sentence without it: near copies share that."""
    reader = Reader()
    for b in batches:
        grams, others, classes = [], [], []
        for text, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            plain, _ = normalised(text or "")
            read = {s: grams_of(reader.plain(s)[0]) for s in dict.fromkeys(_SENTENCE.split(plain))}
            hashes = sorted((zlib.crc32(s.encode()), s) for s, g in read.items() if g)
            found: dict[str, int] = {}
            for inside in read.values():
                for g in inside:
                    if g not in found:
                        found[g] = next((h for h, s in hashes if g not in read[s]), zlib.crc32(plain.encode()))
            grams += found
            others += found.values()
            classes += [cell % 2] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(others, pa.int64()), pa.array(classes, pa.int32())], names=["gram", "other", "abusive"])


def _counter(grams: list[str]):
    """How many documents of each fold and class hold each phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grams)
        held = np.zeros((len(grams), 2 * FOLDS), np.int64)
        for b in batches:
            for text, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[int] = set()
                for got in reader.sentences(text or "")[0]:
                    if got.__class__ is not int and got[2] is not None:
                        found.update(got[2][8])
                held[list(found), cell] += 1
        gram, cell = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(held[gram, cell])], names=["gram", "cell", "n"])

    return count


def _examples(grams: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grams)
        for b in batches:
            got = [reader.read(t) for t in b.column(4).to_pylist()]
            x = [base.tolist() for base, _ in got]
            # the phrases of a sentence follow a negative number: -2 if it speaks of somebody, else -1
            hits = [[v for ids, directed in h for v in (-2 if directed else -1, *ids)] for _, h in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(x, pa.list_(pa.float32())), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "y", "n", "cell", "x", "hits"]
            )

    return rows


def _sentences_of(flat: list[int]) -> list[tuple[tuple[int, ...], bool]]:
    out: list[tuple[list[int], bool]] = []
    for v in flat:
        if v < 0:
            out.append(([], v == -2))
        else:
            out[-1][0].append(v)
    return [(tuple(ids), directed) for ids, directed in out]


def learn_phrases(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From (doc_id, text, cell), cell being 2 * fold + (1 if abusive): phrases, their log-odds, and those without each fold."""
    size = np.zeros(2 * FOLDS)
    for r in sample.groupBy("cell").count().collect():
        size[r["cell"]] = r["count"]
    # about as many other documents show which phrases are common: those stand in nearly as many of them
    every = max(1, int(size[0::2].sum() / max(1, size[1::2].sum())))
    shown = sample.where((F.col("cell") % 2 == 1) | (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(every)) == 0)).select("text", "cell")
    others = F.count_distinct(F.when(F.col("abusive") == 1, F.col("other"))).alias("n")
    often = shown.mapInArrow(_candidates, "gram string, other bigint, abusive int").groupBy("gram").agg(others, F.count_if(F.col("abusive") == 0).alias("plain"))
    often = often.where((F.col("n") >= GRAM_DOCUMENTS) & (F.col("plain") <= 2 + F.col("n") / 4))
    grams = [r["gram"] for r in often.orderBy(F.desc("n"), "gram").limit(MAX_GRAMS).collect()]
    if not grams:
        return [], np.zeros(0), np.zeros((FOLDS, 0))
    counted = sample.select("text", "cell").mapInArrow(_counter(grams), "gram int, cell int, n bigint")
    held = np.zeros((len(grams), 2 * FOLDS))
    for r in counted.groupBy("gram", "cell").agg(F.sum("n").alias("n")).collect():
        held[r["gram"], r["cell"]] = r["n"]
    negative, positive = held[:, 0::2], held[:, 1::2]
    n_negative, n_positive = size[0::2], size[1::2]
    # one document more than without a fold: what the trees learn to trust has been seen by others besides its own document
    full = log_odds(positive.sum(1), negative.sum(1), n_positive.sum(), n_negative.sum(), GRAM_DOCUMENTS + 1)
    apart = np.stack(
        [log_odds(positive.sum(1) - positive[:, k], negative.sum(1) - negative[:, k], n_positive.sum() - n_positive[k], n_negative.sum() - n_negative[k]) for k in range(FOLDS)]
    )
    used = np.flatnonzero((full > 0) | (apart > 0).any(0))
    return [grams[k] for k in used], full[used], apart[:, used]


def fit_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AbuseModel:
    chosen = votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    cell = 2 * F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)) + (F.col("y") >= 0.5).cast("bigint")
    joined = cut_lineage(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "n", cell.cast("int").alias("cell"), "text"))
    grams, odds, apart = learn_phrases(joined)
    got = joined.mapInArrow(_examples(grams), "doc_id bigint, y double, n bigint, cell int, x array<float>, hits array<int>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return AbuseModel(None, None, THRESHOLD)
    base = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(BASE_FEATURES))
    folds = got.column("cell").to_numpy() // 2
    learned = [learned_features(_sentences_of(h), apart[k]) for h, k in zip(got.column("hits").to_pylist(), folds.tolist(), strict=True)]
    x = np.concatenate([base, np.array(learned, np.float32).reshape(-1, len(LEARNED_FEATURES))], 1)
    y = (got.column("y").to_numpy() >= 0.5).astype(float)
    keep = np.flatnonzero(odds > 0)
    return train(x, y, np.sqrt(got.column("n").to_numpy().astype(float)), [grams[k] for k in keep], odds[keep])


def abuse_scores(documents: DataFrame, model: AbuseModel) -> DataFrame:
    """(doc_id, score, flagged) of every row; no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.grams)
        for b in batches:
            s = model.score(feature_matrix(b.column(1).to_pylist(), reader, model.odds))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= model.threshold)], names=["doc_id", "score", "flagged"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        score, "doc_id bigint, score double, flagged boolean"
    )


def source_rates(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents, flagged documents and their share per source (null is a source of its own)."""
    per_doc = scores.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("flagged").alias("flagged"))
    sources = documents.select("doc_id", "source").distinct()
    return sources.join(per_doc, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if("flagged").alias("n_flagged"),
        F.avg(F.col("flagged").cast("int")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
