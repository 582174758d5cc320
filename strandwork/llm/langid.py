"""Languages of documents and of the stretches of mixed ones.

A document's prose words are taken as drawn from a mixture of languages, each a character n-gram model. Expectation-
maximisation estimates the proportions; the set of languages is the one with the best likelihood less a penalty for each
language; the words are then laid out along the text as runs of languages of that set (most probable path with a cost
for each change), and runs too short to be a stretch are taken out.

The models are fitted on a bounded sample of labelled rows (``sample`` documents per language) and a few seed sentences;
as labels can be wrong, each line of the sample goes to the language the models of the round before hold most probable.
Everything else reads all rows and whole texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import wide

# The languages with their usual notations.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles",
    "de": "de deu ger german deutsch allemand alemán",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano castilian spanisch",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano italienisch",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語 jp",
}
LANGS = list(NAMES)
NOTATION = {name: lang for lang, names in NAMES.items() for name in names.split()}

SEEDS = {
    "en": "the of and to in is that it was for on are with as they at be this have from or one had by but not what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know whose nobody somebody which should between",
    "de": "der die das und ist nicht ein eine einer eines zu den dem des mit sich von auf für als auch es an werden aus er hat dass sie nach wird bei noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn sind wir ihr ihre kann gegen vom schon jede jeder keine keiner damit sobald solange während weil denn niemand",
    "fr": "le la les de des et est un une du en que qui dans pour pas au sur ne se ce il elle sont avec par plus nous vous cette ces mais ou où être avoir fait aussi leur leurs tout tous sans comme afin dès que puisque personne lorsque avant après entre deux même peut chaque notre rien encore l'un d'une qu'il n'est c'est",
    "es": "el la los las de y que en un una es por con no para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro nadie siempre salvo cada nuestro del",
    "pt": "o a os as de e que em um uma é do da dos das no na nos nas por com não para se mais como mas ao ele ela seu sua ou quando muito já também só pelo pela até isso entre era depois sem mesmo aos seus quem me esse eles você essa num nem suas meu às minha numa pelos nossa ninguém cada pois assim que antes",
    "it": "il lo la i gli le di e che in un una è per con non si da del della dei delle al alla ai nel nella sul come più o ma se anche ci sono ha questo questa quando dopo senza tra fra molto già loro suo sua ogni nessuno perché finché mentre prima ancora chi cui dove nostro quello all'interno dell'altro l'ha",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit door naar over hij ze wij we jullie hun wordt worden kan zal moet nog meer geen wel deze dit die wat wie waar omdat zodat totdat terwijl zodra niemand iedere elke onze voordat nadat tenzij sinds tussen",
    "ru": "и в не на что он она оно они с как это по но из у за от так же для все его её их мы вы я был была были бы до если когда уже или ни нет только ещё тоже при чтобы после без между пока никто каждый каждая потому который которая где перед наш этот эта",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ における および いう さらに でも ら たり その他 に関する たち ます ん なら に対して",
}

#: Labelled documents per language that the models are fitted on.
SAMPLE = 600
ORDER = 5
#: A run of fewer words is no stretch; a text of fewer words of prose is no case.
LEAST_RUN, LEAST_PROSE = 6, 5
#: Japanese is counted in pieces of two letters; so many make a run even without the end of a sentence.
LEAST_PIECES = 10
CHANGE_COST, LANGUAGE_COST = 9.0, 9.0
REMEMBERED = 300_000
#: Words of the sample that go out with their scores.
SHIPPED = 20_000

_HIDE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|https?://\S+|<\|\w+\|>", re.S)
_LINE = re.compile(r"[^\r\n]+")
_NO_PROSE = re.compile(r"(?: {4}|\t)|\s*\||\s*#|\s*>")
_JA = "぀-ヿ㐀-䶿一-鿿ｦ-ﾝ々ー"
_WORD = re.compile(rf"[{_JA}]{{1,2}}|[^\W\d_{_JA}]+(?:['’][^\W\d_{_JA}]+)*'?")
_JA_START = re.compile(f"[{_JA}]")


def notation(label: str | None) -> str | None:
    """The language that a label names, in any usual notation, or None."""
    if not label:
        return None
    s = label.strip().lower()
    return NOTATION.get(s) or NOTATION.get(re.split(r"[-_. (]", s)[0])


def prose(text: str) -> str:
    """The text with code, headings, tables, quotations and addresses blanked out, at the same length."""
    blank = lambda m: re.sub(r"[^\r\n]", " ", m.group())
    text = _HIDE.sub(blank, text)
    return _LINE.sub(lambda m: " " * len(m.group()) if _NO_PROSE.match(m.group()) else m.group(), text)


@lru_cache(maxsize=REMEMBERED)
def _form(w: str) -> str | None:
    """A word in lower case, None for an identifier."""
    tail = w[1:]
    if not tail.islower() and any(c.isupper() for c in tail) and any(c.islower() for c in w):
        return None
    return w.lower().replace("’", "'")


def words(text: str) -> list[tuple[str, int, int]]:
    """(lower-case word, start, end); Japanese comes in pieces of up to two letters, identifiers are left out."""
    found = [(_form(m.group()), *m.span()) for m in _WORD.finditer(text)]
    return [f for f in found if f[0] is not None]


def _bare(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


class Models:
    """A character n-gram model for each language, each order backing off to the one below."""

    def __init__(self):
        self.grams = [Counter() for _ in LANGS]
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGS)))

    def __getstate__(self):
        return [dict(g) for g in self.grams], list(self.known), self.table[: len(self.known)]

    def __setstate__(self, state):
        self.__init__()
        self.grams, known, table = state
        self.known = {w: i for i, w in enumerate(known)}
        self.table = np.concatenate([table, np.zeros((1024, len(LANGS)))])

    def add(self, lang: int, word: str, times: int) -> None:
        g = self.grams[lang]
        for form, weight in ((word, 3 * times), (_bare(word), times)):
            s = f" {form} "
            for i in range(1, len(s)):
                for n in range(min(ORDER, i + 1)):
                    g[s[i - n : i + 1]] += weight
                    g["\0" + s[i - n : i]] += weight

    def _score(self, word: str) -> list[float]:
        s, out = f" {word} ", []
        for g in self.grams:
            total = 0.0
            for i in range(1, len(s)):
                p = 1e-5
                for n in range(min(ORDER, i + 1)):
                    seen = g.get("\0" + s[i - n : i], 0)
                    if not seen:
                        break
                    p = (g.get(s[i - n : i + 1], 0) + 4.0 * p) / (seen + 4.0)
                total += math.log(p)
            out.append(total)
        # a single word is never held for certain
        top = max(out)
        return [max(x, top - 12.0) for x in out]

    def rows(self, ws: list[str]) -> np.ndarray:
        """Log likelihood of each word (row) in each language (column)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        at = []
        for w in ws:
            i = self.known.get(w)
            if i is None:
                i = self.known[w] = len(self.known)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[i] = self._score(w)
            at.append(i)
        return self.table[at]


def fit(rows: list[tuple[str, str]], rounds: int = 2) -> Models:
    """Fit from (text, label) rows; a line's words count for the language that the round before finds in it."""
    lines: list[tuple[int, list[str]]] = []
    for text, label in rows:
        for line in re.split(r"[\r\n]+|(?<=[.。!?])\s*", prose(text)):
            ws = [w for w, _, _ in words(line)]
            if len(ws) >= 4:
                lines.append((LANGS.index(label), ws))

    def build(assigned: list[int]) -> Models:
        m = Models()
        for k, lang in enumerate(LANGS):
            for w, n in Counter(w for w, _, _ in words(SEEDS[lang])).items():
                m.add(k, w, n)
        total = [Counter() for _ in LANGS]
        for k, (_, ws) in zip(assigned, lines):
            total[k].update(ws)
        for k, c in enumerate(total):
            for w, n in c.items():
                m.add(k, w, n)
        return m

    models = build([k for k, _ in lines])
    for _ in range(rounds):
        models = build([int(models.rows(ws).sum(axis=0).argmax()) for _, ws in lines])
    models.known.clear()
    # the commonest words are scored once for all
    often = Counter(w for _, ws in lines for w in ws)
    models.rows([w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:SHIPPED]])
    return models


def mixture(ll: np.ndarray, rounds: int = 12) -> tuple[list[int], np.ndarray]:
    """The languages of a text and their proportions, by expectation-maximisation and penalised likelihood."""

    def em(langs: list[int]) -> tuple[float, np.ndarray]:
        sub = ll[:, langs]
        top = sub.max(axis=1, keepdims=True)
        like = np.exp(sub - top)
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(rounds if len(langs) > 1 else 0):
            r = like * share
            r /= r.sum(axis=1, keepdims=True)
            share = r.mean(axis=0)
        return float(np.log((like * share).sum(axis=1)).sum() + top.sum()), share

    _, share = em(list(range(ll.shape[1])))
    langs = [int(k) for k in np.flatnonzero(share * len(ll) >= 2.0)] or [int(share.argmax())]
    # where one language is far ahead of any mixture there is nothing to select
    best = int(ll.sum(axis=0).argmax())
    if langs == [best]:
        return langs, np.ones(1)
    score, share = em(langs)
    while len(langs) > 1:
        options = []
        for k in range(len(langs)):
            rest = langs[:k] + langs[k + 1 :]
            options.append((*em(rest), rest))
        s, sh, rest = max(options, key=lambda o: o[0])
        if s + LANGUAGE_COST < score:
            break
        score, share, langs = s, sh, rest
    return langs, share


def _path(ll: np.ndarray) -> np.ndarray:
    """The most probable run of languages along the words, with a cost for each change."""
    n, k = ll.shape
    score = ll[0].copy()
    back = np.zeros((n, k), dtype=np.int16)
    own = np.arange(k)
    for i in range(1, n):
        b = int(score.argmax())
        jump = score[b] - CHANGE_COST
        stay = score >= jump
        back[i] = np.where(stay, own, b)
        score = np.where(stay, score, jump) + ll[i]
    out = np.zeros(n, dtype=np.int16)
    out[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def stretches(text: str | None, models: Models) -> tuple[list[tuple[str, float, int, int, int]], bool]:
    """([(lang, confidence, start, end, words)], whether the text has prose enough to be judged)."""
    if not text:
        return [], False
    plain = prose(text)
    ws = words(plain)
    if not ws:
        return [], False
    ja = np.array([_JA_START.match(w) is not None for w, _, _ in ws])
    sentence = ja.any() and re.search(f"[{_JA}][^{_JA}]{{0,40}}。|。", plain) is not None
    enough = int((~ja).sum()) >= LEAST_PROSE or bool(sentence and ja.sum() >= 3) or int(ja.sum()) >= LEAST_PIECES
    ll = models.rows([w for w, _, _ in ws])
    langs, share = mixture(ll)
    if len(langs) > 1:
        path = [langs[i] for i in _path(ll[:, langs] + np.log(np.maximum(share, 0.02)))]
    else:
        path = [langs[0]] * len(ws)
    runs: list[list[int]] = []
    for i, k in enumerate(path):
        if runs and runs[-1][0] == k:
            runs[-1][2] = i + 1
        else:
            runs.append([k, i, i + 1])

    def long_enough(k: int, a: int, b: int) -> bool:
        if LANGS[k] != "ja":
            return b - a >= LEAST_RUN
        pieces = int(ja[a:b].sum())
        return pieces >= LEAST_PIECES or (pieces >= 4 and "。" in plain[ws[a][1] : ws[b - 1][2] + 2])

    kept = [r for r in runs if long_enough(*r)]
    if not kept:
        size = Counter()
        for k, a, b in runs:
            size[k] += b - a
        k = max(size, key=lambda x: (size[x], -x))
        kept = [[k, 0, len(ws)]]
    merged: list[list[int]] = []
    for r in kept:
        if merged and merged[-1][0] == r[0]:
            merged[-1][2] = r[2]
        else:
            merged.append(list(r))
    out = []
    for k, a, b in merged:
        part = ll[a:b] - ll[a:b].max(axis=1, keepdims=True)
        p = np.exp(part)
        p /= p.sum(axis=1, keepdims=True)
        out.append((LANGS[k], float(np.clip(p[:, k].mean(), 0.0, 1.0)), ws[a][1], ws[b - 1][2], b - a))
    return out, enough


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``sample`` labelled texts per language, chosen by a hash of the id; never more than three times that."""
    pairs = F.create_map(*[F.lit(x) for kv in NOTATION.items() for x in kv])
    s = F.lower(F.trim("lang"))
    named = docs.select("doc_id", "text", F.coalesce(pairs[s], pairs[F.split(s, r"[-_. (]")[0]]).alias("lang")).where("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.5 * sample / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1e6
    chosen = named.where(draw < share[F.col("lang")]).select("lang", "text", "doc_id").limit(3 * sample * len(LANGS)).collect()
    by: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], str(r["doc_id"]), r["text"])):
        by.setdefault(r["lang"], []).append(r)
    return [(r["text"], lang) for lang, rs in by.items() for r in rs[: 3 * sample]]


def document_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, judged, n_stretches, seg_no, lang, confidence, start, end, n_words): the stretches of every document in order.

    label is the language that documents.lang names, null where it names none; judged is false where the text has too
    little prose to be a case. confidence is the mean probability of the stretch's words. A document without any word
    has one row with a null lang, confidence 0. start and end are code points. Repeated rows are judged each for
    itself; other columns are not read; an empty table gives no rows.
    """
    models = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs.select("doc_id", "text", "lang"), sample)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = models.value
        for b in batches:
            rows = []
            for doc, text, label in zip(b.doc_id, b.text, b.lang):
                found, enough = stretches(text, m)
                name = notation(label)
                for no, s in enumerate(found or [(None, 0.0, 0, 0, 0)]):
                    rows.append((doc, name, enough, len(found), no, *s))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "judged", "n_stretches", "seg_no", "lang", "confidence", "start", "end", "n_words"])

    kind = dict(docs.dtypes)["doc_id"]
    source = wide(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), "doc_id")
    return source.mapInPandas(run, f"doc_id {kind}, label string, judged boolean, n_stretches int, seg_no int, lang string, confidence double, start long, end long, n_words int")


def language_cases(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, seg_no, lang): documents without a right label, or with stretches in more than one language."""
    found = document_languages(docs, sample)
    case = "judged and lang is not null and (n_stretches > 1 or label is null or label <> lang)"
    return found.where(case).select("doc_id", "seg_no", "lang")
