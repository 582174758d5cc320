"""Whether documentation says anything: cleaning of comment marks and the test for trivial text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words and notations that carry no description of their own.
_TAG_DROPPED = (
    "param parameter arg argument internal private protected public package packageprivate readonly override overrides virtual abstract "
    "final static async deprecated since version see link author authors date copyright license licence file fileoverview module "
    "namespace memberof class constructor function func method name alias todo fixme ignore hidden inheritdoc api access category "
    "group beta alpha experimental stable type typedef template typeparam generated suppress suppresswarnings nodoc"
).split()
_RESULT_TAGS = "return returns throws throw exception raises yields yield"
_DIRECTIVE = re.compile(
    r"\s*(?:eslint\b|eslint-|jshint\b|jslint\b|tslint:|prettier-ignore|biome-ignore|istanbul\b|c8\b|v8\b|@?ts-(?:ignore|expect-error|nocheck|check)|"
    r"noqa\b|pylint:|pyright:|mypy:|flake8:|ruff:|type:\s*ignore|pragma:|fmt:|isort:|yapf:|nosec\b|go:[a-z]|\+build|nolint\b|lint:|"
    r"nosonar\b|checkstyle|cspell:|codespell:|noinspection\b|suppresswarnings|language=|region\b|endregion\b|<editor-fold|skipcq|sonar|"
    r"webpack\w*:|vite-|@vite|coverage:|lgtm\b|rubocop|swiftlint|clang-format|spell-?checker)",
    re.I,
)
_FILLER = set(
    "a an the this that these those it its itself is are was were be been being do does did doing done has have had to of for in on at by with "
    "from into as and or what which who whose how when here there exactly simply just merely only basically obviously really very same so "
    "function functions func fn method methods procedure routine helper helpers utility util class member operation name named called says "
    "say implies suggests indicates see self explanatory will would can may shall must should i e eg ie etc our my your we you they he she".split()
)
_ABSENCE = set(
    "todo todos fixme xxx hack wip tbd tba tbc na n none null nil nothing empty blank missing absent lacking lacks undocumented undescribed "
    "documentation documentations documented document documents documenting doc docs docstring docstrings javadoc jsdoc godoc comment comments "
    "commented description descriptions described describe describes text texts explanation explain explained details detail summary note notes "
    "placeholder stub stubs boilerplate template scaffold scaffolding scaffolded skeleton lorem ipsum auto automatically generated generate "
    "generator autogenerated tool tools ide editor please replace replaced fill filled write written writing add added adding insert put "
    "provide provided supply update updated fix fixed improve complete completed finish finished follow follows following come coming pending "
    "proper properly real actual good better useful meaningful own before after until next later soon now yet still eventually someday "
    "sometime release version change commit sprint day time times once somebody someone anybody nobody no not never any some more finds find "
    "found gets get there goes go above below elsewhere other another place file parent base super interface superclass overridden refer refers "
    "reference readme wiki manual guide page site website link ticket issue parameters parameter params param arguments argument args "
    "return returns value values result results inputs outputs usage example examples internal external use used private public protected "
    "deprecated obsolete experimental unstable beta alpha draft work progress under construction inherit inherits inherited available "
    "exists exist needed needs need required requires body left intentionally default one all everything something anything later-on per "
    "unclear unknown incomplete inheritdoc out if but because first where".split()
)
_TRIGGER = re.compile(
    r"\b(?:to[\s-]?do|fix[\s-]?me|xxx|wip|tb[dac]|n/a|none|undocumented|undescribed|placeholder|stub|boilerplate|auto-?generated|automatically generated|"
    r"generated (?:by|from|code|comment|doc|method|stub)|scaffold\w*|template|lorem ipsum|missing|absent|lacking|lacks|goes here|here|to (?:be|come|follow)|"
    r"will (?:be|follow|come)|later|soon|yet|pending|not (?:yet )?(?:documented|described|available|written)|no (?:docs?|documentation|description|comments?|docstring|javadoc|text|details|explanation|summary)|nobody|nothing|"
    r"see|refer(?:s|ring)? (?:to|back)|inherit\w*|(?:as|described|documented|explained|noted|stated|comments?|docs?|documentation|description) (?:\w+ )?(?:above|below)|elsewhere|internal(?:ly)?|private|public|deprecated|obsolete|experimental|unstable|draft|work in progress|under construction|"
    r"replace (?:this|me|with|it)|replace (?:\w+ ){0,2}(?:text|comment|docs?|documentation|description|docstring|placeholder)|empty|fill (?:in|this|me|out)|(?:add|write|insert|provide|put|fix|improve|complete) (?:\w+ ){0,3}(?:docs?|documentation|description|comments?|docstring|text)|"
    r"description(?: of)?|documentation(?: for| of)?|docs?|comment|docstring|self[- ]explanatory)\b",
    re.I,
)
#: The same said in other languages: absent, generated, elsewhere or still to come.
_FOREIGN_ABSENCE = re.compile(
    r"(?:noch (?:nicht|zu|ohne|keine?)\b.*(?:dokument|beschr|beschreib)|keine? (?:dokumentation|beschreibung|angabe)|beschreibung (?:fehlt|folgt)|dokumentation (?:fehlt|folgt)|folgt (?:noch|später)|siehe (?:oben|unten)|automatisch (?:erzeugt|generiert)|undokumentiert|"
    r"(?:pas|aucune?|sans) (?:encore )?(?:de )?(?:document|descr)|à (?:documenter|compléter|faire|décrire)|documentation (?:à venir|manquante)|description (?:à venir|manquante)|voir (?:ci-dessus|plus haut|ci-dessous)|généré automatiquement|non documenté|"
    r"(?:sin|falta(?: la)?|pendiente de|por) (?:document|descri)|documentaci[oó]n pendiente|descripci[oó]n pendiente|v[eé]ase (?:arriba|abajo|m[aá]s)|generado autom[aá]ticamente|por hacer|no documentad|"
    r"sem (?:document|descri)|documenta[cç][aã]o (?:pendente|em falta)|descri[cç][aã]o pendente|a documentar|ver acima|gerado automaticamente|por documentar|n[aã]o documentad|"
    r"senza (?:document|descri)|da documentare|documentazione (?:mancante|assente)|descrizione mancante|vedi sopra|generato automaticamente|non documentat|"
    r"(?:nog )?(?:geen|niet) (?:document|beschr|gedocument)|nog te (?:document|beschr|doen)|zie (?:boven|hierboven|onder)|automatisch gegenereerd|ongedocumenteerd|documentatie (?:volgt|ontbreekt)|beschrijving (?:volgt|ontbreekt)|"
    r"нет (?:описания|документации)|без (?:описания|документации)|описание (?:отсутствует|будет|позже)|документация (?:отсутствует|будет|появится)|не (?:описан|документирован)|см\. (?:выше|ниже)|сгенерирован|"
    r"未(?:記載|記述|文書化|作成|定)|説明(?:なし|は後|未)|(?:後で|あとで)(?:書|記)|自動生成|ドキュメント(?:なし|未)|上記参照|上を参照)",
    re.I,
)
#: One of these is in whatever the expression above finds, so that most sentences need no search.
_FOREIGN_HINTS = (
    "dokument", "beschr", "angabe", "folgt", "siehe", "automatisch", "docum", "descr", "à ", "voir ", "généré", "ase ", "generado", "por hacer", "ver acima", "gerado", "vedi sopra", "generato", "nog te", "zie ",
    "описан", "документ", "см.", "сгенерирован", "未", "説明", "後で", "あとで", "自動生成", "ドキュメント", "上記参照", "上を参照",
)
_EDGE = re.compile(r"^\s*(?:/\*+|\*+/|\*+(?!\*)|//[/!]?|#+!?|--|;+|%+|\"\"\"|''')?[ \t]?|\s*(?:\*+/|\"\"\"|''')\s*$")
_TAG = re.compile(r"\s*(?:[@\\](\w+)|:(\w+)[^:\n]*:)(.*)", re.S)
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")


def clean(doc: str | None) -> str:
    """The text of a comment without its marks."""
    if not doc:
        return ""
    lines = []
    for line in re.split(r"\r\n|\r|\n", doc.replace("﻿", "")):
        last = None
        while last != line:
            last, line = line, _EDGE.sub("", line)
        lines.append(line.rstrip())
    return "\n".join(lines).strip()


@lru_cache(maxsize=100_000)
def _stem(w: str) -> str:
    for end in ("ing", "ers", "ed", "er", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] in "eiy":
        w = w[:-1]
    # a doubled consonant before an ending: dropped, dropping
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


@lru_cache(maxsize=100_000)
def name_words(name: str | None) -> frozenset[str]:
    parts = [p.lower() for p in _PART.findall(name or "")]
    return frozenset([*map(_stem, parts), _stem("".join(parts))])


def informative(doc: str | None, name: str | None) -> bool:
    """Whether documentation tells anything about behaviour, input, result or use."""
    text = unicodedata.normalize("NFC", clean(doc))
    own = name_words(name)
    kept = []
    for line in text.split("\n"):
        if _DIRECTIVE.match(line):
            continue
        line = re.sub(r"\{@inheritDoc\}", " ", line, flags=re.I)
        tag = _TAG.match(line)
        if tag:
            word = (tag.group(1) or tag.group(2)).lower()
            rest = re.sub(r"\{[^}]*\}", " ", tag.group(3))
            if word in _RESULT_TAGS.split():
                # a result or error is told if more than its type is
                if len([w for w in _WORDS.findall(rest) if w.lower() not in _FILLER and w.lower() not in _ABSENCE and _stem(w.lower()) not in own]) > 1:
                    return True
                continue
            if word in _TAG_DROPPED or tag.group(1):
                continue
            if tag.group(2) in ("type", "rtype", "meta"):
                continue
        kept.append(line)
    # a line end does not end a sentence, a blank line or rule does
    blocks = re.split(r"\n\s*\n|\n\W*\n", "\n".join(kept))
    said = [_says(x, own) for b in blocks for x in re.split(r"(?<=[.!?;。！？])\s*", b.replace("\n", " "))]
    # words of documentation's absence alone tell something only where nothing marks it as absent
    return "yes" in said or ("words" in said and "absent" not in said)


def _says(sentence: str, own: set[str]) -> str:
    words = [w.lower().replace("’", "'") for w in _WORDS.findall(sentence.replace("_", " "))]
    for w in _WORDS.findall(sentence):
        # the name in any spelling counts as its words
        if name_words(w) <= own and w.lower() in words:
            words = [x for x in words if x != w.lower()]
    words = [w for w in words if w not in _FILLER and not w.isdigit() and _stem(w) not in own]
    if words:
        low = sentence.lower()
        if any(h in low for h in _FOREIGN_HINTS) and _FOREIGN_ABSENCE.search(sentence):
            return "absent"
        if not all(w in _ABSENCE or re.fullmatch(r"v?\d+\w*", w) for w in words):
            return "yes"
    marked = _TRIGGER.search(sentence) is not None
    return "absent" if marked else "words" if words else ""
