"""Distributions of length, vocabulary, syntax and cohesion of whole texts, of many texts at once."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

# Closed classes of English words.
SUBORDINATORS = "because although though while whereas since unless until if when whenever after before that which who whom whose where insofar notwithstanding provided lest once than as".split()
PREPOSITIONS = "of in to for with on at by from about into over after under between through against during without within upon among beyond behind near".split()
CONNECTIVES = "however therefore consequently moreover furthermore thus hence nevertheless then first next finally also instead otherwise accordingly meanwhile".split()
PRONOUNS = "i you he she it we they me him her us them my your his its our their this these those".split()
AUXILIARIES = "is are was were be been being am has have had do does did will would shall should can could may might must".split()
ARTICLES = "a an the".split()
CONJUNCTIONS = "and or but nor so yet".split()
ABSTRACT_ENDINGS = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "ism", "ship", "logy", "graphy", "ture", "acy")

_CLASSES = [frozenset(c) for c in (SUBORDINATORS, PREPOSITIONS, CONNECTIVES, PRONOUNS, AUXILIARIES, ARTICLES, CONJUNCTIONS)]
#: Columns of a word's properties.
CHARS, SYLLABLES, POLY, CLASS = 0, 1, 2, 3
SUBORDINATOR, PREPOSITION, CONNECTIVE, AUXILIARY, CONJUNCTION = CLASS, CLASS + 1, CLASS + 2, CLASS + 4, CLASS + 6
PAST = CLASS + len(_CLASSES) + 2

_MARK = "\x1e"  # stands for the end of a sentence
_PUNCTUATION = ",;:.!?()"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[" + _MARK + _PUNCTUATION + "]")
_END = re.compile(r"([.!?][\"'”’)\]]?)\s+(?=[\"'“‘(\[]?[^\W\d_a-z]|[*\-•]\s|\d+[.)]\s)")
_BREAK = re.compile(r"\n\s*\n|\n(?=\s*(?:[*\-•]|\d+[.)])\s)")
_PATH = re.compile(r"(?<!\S)\S*[/\\]\S*")
_FILE = re.compile(r"\b\w+\.(?:jpe?g|png|heic|mov|mp4|nef|xmp|json|txt|tsv|tiff?)\b", re.I)
_FILE_END = re.compile(r"\.(?:jpe?g|png|heic|mov|mp4|nef|xmp|json|txt|tsv|tiff?)\b", re.I)
_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèùâêîôû]+")

QUANTILES = (10, 50, 90)
#: Characters of the texts worked on at once.
CHUNK = 1_000_000


def syllables(word: str) -> int:
    groups = len(_VOWELS.findall(word))
    if word.endswith("e") and not word.endswith(("le", "ee")) and groups > 1:
        groups -= 1
    return max(1, groups)


class Vocabulary(dict):
    """Numbers of the words met so far in this process, and their properties as a growing array.

    The first numbers are the mark and the punctuation.
    """

    COLUMNS = PAST + 1

    def __init__(self) -> None:
        super().__init__({c: i for i, c in enumerate(_MARK + _PUNCTUATION)})
        self.first_word = len(self)
        self.held = np.zeros((4096, self.COLUMNS), dtype=np.float32)

    def __missing__(self, w: str) -> int:
        self[w] = at = len(self)
        if at >= len(self.held):
            self.held = np.vstack([self.held, np.zeros_like(self.held)])
        s = syllables(w)
        self.held[at] = [len(w), s, s >= 3, *[w in c for c in _CLASSES], len(w) > 6 and w.endswith(ABSTRACT_ENDINGS), len(w) > 4 and w.endswith("ly"), len(w) > 3 and w.endswith("ed")]
        return at

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()
            self.__init__()


NAMES = [
    "log_words", "log_sentences",
    *[f"sentence_words_{q}" for q in ("mean", "std", *QUANTILES)], *[f"word_chars_{q}" for q in ("mean", "std", *QUANTILES)],
    *[f"syllables_{q}" for q in ("mean", "std", *QUANTILES)], "long_words", "very_long_words", "polysyllables", "root_types", "once_only",
    "subordinators", "prepositions", "connectives", "pronouns", "auxiliaries", "articles", "conjunctions", "abstract", "adverbs", "past",
    "commas", "semicolons", "questions", "exclamations", "subordinators_per_sentence", "prepositions_per_sentence", "conjunctions_per_sentence",
    "clause_words_mean", "clause_words_90", "clauses_per_sentence_mean", "clauses_per_sentence_90", "subordinated_sentences", "prepositions_in_sentence_90",
    "words_before_auxiliary", "passives", "overlap_mean", "overlap_share", "start_connectives", "digits", "capitals", "flesch_kincaid",
]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each character code up to 0xFFFF: 1 letter, 2 digit, 4 capital."""
    return np.array([c.isalpha() + 2 * c.isdigit() + 4 * c.isupper() for c in map(chr, range(0x10000))], dtype=np.uint8)


def _character_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, digits and capitals of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _kinds()[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        c = chr(codes[at])
        kinds[at] = c.isalpha() + 2 * c.isdigit() + 4 * c.isupper()
    ends = np.cumsum([len(t) for t in texts])

    def per_text(flag: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kinds & flag > 0)])
        return np.diff(upto[np.concatenate([[0], ends])])

    return per_text(1), per_text(2), per_text(4)


def _tokens(text: str) -> list[str]:
    if "/" in text or "\\" in text:
        text = _PATH.sub(" ", text)
    if _FILE_END.search(text):
        text = _FILE.sub(" ", text)
    text = _END.sub(r"\1" + _MARK, text)
    if "\n" in text:
        text = _BREAK.sub(_MARK, text)
    return _TOKEN.findall(text.lower())


class _Groups:
    """Statistics of values by group; the groups' numbers ascend along the values, and each has one at least."""

    def __init__(self, group: np.ndarray, groups: int) -> None:
        self.group, self.count = group, np.bincount(group, minlength=groups)
        self.starts = np.cumsum(self.count) - self.count

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, values, len(self.count))

    def mean(self, values: np.ndarray) -> np.ndarray:
        return self.sum(values) / np.maximum(1, self.count)

    def quantiles(self, values: np.ndarray, at: tuple[int, ...] = QUANTILES) -> list[np.ndarray]:
        """Linearly interpolated percentiles of whole, non-negative values."""
        ordered = np.sort((self.group.astype(np.int64) << 32) | values.astype(np.int64)) & 0xFFFFFFFF
        out = []
        for q in at:
            place = q / 100 * (self.count - 1)
            low = place.astype(np.int64)
            a, b = ordered[self.starts + low], ordered[self.starts + np.minimum(low + 1, self.count - 1)]
            out.append(a + (b - a) * (place - low))
        return out

    def spread(self, values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(np.float64)
        mean = self.mean(values)
        return [mean, np.sqrt(np.maximum(0, self.mean(values**2) - mean**2)), *self.quantiles(values)]


def _renumber(ascending: np.ndarray) -> np.ndarray:
    """Ascending group numbers without gaps, from 0."""
    return np.cumsum(np.concatenate([[False], ascending[1:] != ascending[:-1]]))


def _chunk_features(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    out = np.zeros((len(texts), len(NAMES)), dtype=np.float32)
    found = [_tokens(t) for t in texts]
    sizes = np.array([len(f) for f in found])
    token = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(sizes.sum()))
    of_text = np.repeat(np.arange(len(texts)), sizes)
    is_word = token >= vocabulary.first_word
    filled = np.bincount(of_text[is_word], minlength=len(texts)) > 0
    if not filled.any():
        return out
    keep = filled[of_text]
    token, of_text, is_word = token[keep], _renumber(of_text[keep]), is_word[keep]
    total = int(of_text[-1]) + 1
    new_text = np.concatenate([[True], of_text[1:] != of_text[:-1]])
    word, text = token[is_word], of_text[is_word]
    sentence = _renumber(np.cumsum((token == 0) | new_text)[is_word])
    clause = _renumber(np.cumsum(((token > 0) & ~is_word) | new_text)[is_word])
    held = vocabulary.held[word]
    chars, syl = held[:, CHARS], held[:, SYLLABLES]

    words = _Groups(text, total)
    in_sentence = _Groups(sentence, int(sentence[-1]) + 1)
    text_of_sentence = text[in_sentence.starts]
    sentences = _Groups(text_of_sentence, total)
    in_clause = _Groups(clause, int(clause[-1]) + 1)
    clauses = _Groups(text[in_clause.starts], total)
    n, m = words.count, sentences.count
    marks = np.stack([np.bincount(of_text[token == k], minlength=total) for k in range(len(_PUNCTUATION) + 1)])

    types, counts = np.unique((text << 32) | word, return_counts=True)
    kinds = _Groups(types >> 32, total)
    shares = [words.mean(held[:, c]) for c in range(CLASS, PAST + 1)]
    pieces = np.unique((sentence << 32) | clause) >> 32  # one for each part of a clause in a sentence
    per_sentence = np.bincount(pieces, minlength=len(text_of_sentence))
    prepositions = in_sentence.sum(held[:, PREPOSITION])
    place = np.arange(len(word)) - in_sentence.starts[sentence]
    auxiliary = held[:, AUXILIARY] > 0
    before = in_sentence.count.copy()
    np.minimum.at(before, sentence[auxiliary], place[auxiliary])
    passive = np.zeros(len(word), dtype=bool)
    passive[1:] = auxiliary[:-1] & (held[1:, PAST] > 0) & (sentence[1:] == sentence[:-1])

    heavy = chars > 3
    pairs = np.unique((sentence[heavy] << 32) | word[heavy])
    following = np.append(text_of_sentence[1:] == text_of_sentence[:-1], False)
    distinct = np.bincount(pairs >> 32, minlength=len(text_of_sentence))
    beyond = pairs + (1 << 32)
    again = np.append(pairs, -1)[np.searchsorted(pairs, beyond)] == beyond
    shared = np.bincount((pairs >> 32)[again], minlength=len(text_of_sentence)) * following / np.maximum(1, distinct)
    gaps = np.maximum(1, m - 1)

    letters, digits, capitals = (c[filled] for c in _character_counts(texts))
    length = np.array([len(t) for t in texts])[filled]
    values = [
        np.log1p(n), np.log1p(m), *sentences.spread(in_sentence.count), *words.spread(chars), *words.spread(syl),
        words.mean(chars >= 7), words.mean(chars >= 11), words.mean(held[:, POLY]), kinds.count / np.sqrt(2 * n), kinds.mean(counts == 1),
        *shares, marks[1] / m, (marks[2] + marks[3]) / m, marks[6] / m, marks[5] / m,
        shares[0] * n / m, shares[1] * n / m, shares[6] * n / m, clauses.mean(in_clause.count), clauses.quantiles(in_clause.count, (90,))[0],
        sentences.mean(per_sentence), sentences.quantiles(per_sentence, (90,))[0], sentences.mean(in_sentence.sum(held[:, SUBORDINATOR]) > 0), sentences.quantiles(prepositions, (90,))[0],
        sentences.mean(before), words.sum(passive) / m, sentences.sum(shared) / gaps, sentences.sum(shared > 0) / gaps, sentences.mean(held[in_sentence.starts, CONNECTIVE]),
        digits / length, capitals / np.maximum(1, letters), 0.39 * n / m + 11.8 * words.mean(syl) - 15.59,
    ]
    out[filled] = np.column_stack(values)
    return out


def feature_rows(texts: list[str]) -> np.ndarray:
    """The values of NAMES for each text; zeros for a text without words."""
    vocabulary, rows, at = Vocabulary(), [np.zeros((0, len(NAMES)), dtype=np.float32)], 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHUNK):
            held += len(texts[stop])
            stop += 1
        rows.append(_chunk_features(texts[at:stop], vocabulary))
        vocabulary.trim()
        at = stop
    return np.concatenate(rows)
