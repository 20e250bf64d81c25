"""Candidates and labelers of the personal kinds that no fixed pattern decides.

A detector finds what may be of its kind in a text and lets labelers (patterns, gazetteers,
context) vote yes, no or nothing on each candidate:

* ``secret``: a run without blanks that a cue word assigns (``password: ...``, ``token=...``);
* ``name``: capitalised words with a known given name first, or after a title or cue;
* ``address``: a house number with a street, number first or street first, and the town;
* ``national_id``: 3-2-4 digit groups, or a run with digits after a cue;
* ``local_phone``: 3-3-4 digit groups, or 7 to 15 grouped digits after a cue.

Digits that a word for something else announces (``version``, ``page``) are no candidates.

What is known of words comes in ``Lexicon``, a parameter: the defaults are short lists of
common words in English and some in French, German and Spanish. It is sent with the code, so
its size is the caller's. Every pattern looks a bounded number of characters ahead or starts
at word borders only, so long texts take linear time.

Defined results: null and empty texts have no candidates; candidates of one detector do not
overlap each other or a base span; kinds may overlap one another."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

NO, NOTHING, YES = 0, 1, 2


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Common words that announce or make up personal data.
_PASSWORDS = _words("password passwd pwd passphrase passcode pin passwort mot-de-passe contraseña")
_GIVEN = _words(
    "james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark "
    "steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas "
    "eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick frank raymond jack dennis "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley "
    "kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia dorothy amy "
    "kathleen angela shirley emma anna pamela nicole samantha katherine christine helen maria olivia sophia julia "
    "pierre jean jacques luc marie claire camille sophie juan carlos jose luis miguel pedro carmen lucia isabel elena "
    "hans klaus jürgen wolfgang stefan anja katrin ursula heike ahmed mohammed fatima ali omar wei ming yuki hiroshi "
    "priya rahul anil sunita ivan olga dmitri natasha")
_SURNAMES = _words(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson "
    "thomas taylor moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young "
    "allen king wright scott torres nguyen hill flores green adams nelson baker hall rivera campbell mitchell carter "
    "roberts müller schmidt schneider fischer weber dubois bernard moreau laurent fernandez kim chen wang singh patel khan")
_STREETS = _words(
    "street st avenue ave road rd lane ln drive dr boulevard blvd court ct way place pl square sq terrace highway hwy "
    "parkway crescent close")
_SECRET_CUES = _words(
    "secret token apikey api_key api-key access_key secret_key auth_token private_key credential credentials")
_NAME_CUES = ("my name is", "name is", "name", "named", "i am", "i'm", "called", "signed", "sincerely", "regards", "dear",
              "contact", "attn", "patient", "customer", "employee", "je m'appelle", "ich heiße", "me llamo")
_TITLES = _words("mr mrs ms miss dr prof sir madam herr frau monsieur madame señor señora")
_PLACES = _words("street avenue road university college school hospital river lake mountain county city inc ltd llc corp "
                 "company bank park museum church day week month")
_ADDRESS_CUES = ("live at", "lives at", "living at", "resides at", "address", "ship to", "mail to", "home at", "located at", "moved to")
_ID_CUES = ("ssn", "social security number", "social security", "national id", "national insurance", "passport", "passport number", "tax id",
            "driver's license", "id card", "dni", "nif", "insee", "steuer-id")
_PHONE_CUES = ("call", "tel", "phone", "telephone", "mobile", "cell", "fax", "text me at", "reach me at", "téléphone", "teléfono", "telefon")
_NUMBER_CUES = _words("version license chapter section page pages volume issue part isbn issn order item model figure table")


_LINKS = _words("is at on no number nr")


@dataclass(frozen=True)
class Lexicon:
    """Lower-case words the labelers know."""
    given: frozenset[str] = field(default=_GIVEN, repr=False)
    surnames: frozenset[str] = field(default=_SURNAMES, repr=False)
    streets: frozenset[str] = field(default=_STREETS, repr=False)
    passwords: frozenset[str] = field(default=_PASSWORDS, repr=False)
    secret_cues: frozenset[str] = field(default=_SECRET_CUES, repr=False)
    name_cues: tuple[str, ...] = field(default=_NAME_CUES, repr=False)
    address_cues: tuple[str, ...] = field(default=_ADDRESS_CUES, repr=False)
    id_cues: tuple[str, ...] = field(default=_ID_CUES, repr=False)
    phone_cues: tuple[str, ...] = field(default=_PHONE_CUES, repr=False)


@dataclass(frozen=True)
class Detector:
    """``find(text)`` gives (start, end); ``vote(text, start, end)`` the labelers' votes and
    further features (0 to 5)."""
    kind: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    vote: Callable[[str, int, int], tuple[tuple[int, ...], tuple[int, ...]]]
    labelers: int
    features: int
    needs_digit: bool = False


def _yes(found: bool, otherwise: int = NOTHING) -> int:
    return YES if found else otherwise


def _either(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _ends_with(words) -> re.Pattern:
    """Whether a text ends with one of the words, a link word and signs."""
    return re.compile(rf"(?<!\w)(?:{_either(words)})(?:\s+(?:me|us))?(?:\s+(?:{_either(_LINKS)}))?[\s.:=#,(\"'-]*$")


def _mentions(text: str, words) -> bool:
    """Whether a word occurs, as a word or in one: a quick test before a slow pattern."""
    lower = text.lower()
    return any(w in lower for w in words)


_LAST_WORD = re.compile(r"(\w+)\W*$")


def _before(text: str, at: int, n: int = 40) -> str:
    return text[max(0, at - n):at].lower()


def _word_before(text: str, at: int) -> str:
    match = _LAST_WORD.search(_before(text, at))
    return match.group(1) if match else ""

_FILLER = re.compile(r"<.*>|\*+|x+|\.+|none|null|true|false|required|optional|string|forgotten|changed|wrong")


def _secrets(lexicon: Lexicon) -> Detector:
    cues = lexicon.passwords | lexicon.secret_cues
    passwords, others = _either(lexicon.passwords), _either(lexicon.secret_cues)
    assigned = re.compile(rf"""(?i)(?<![^\W\d_])(?:(?:{passwords}|{others})["']?\s{{0,3}}[:=]\s{{0,3}}|(?:{passwords})\s{{1,3}}is:?\s{{1,3}})["']?(\S{{4,}})""")
    password = re.compile(rf"(?<![^\W\d_])(?:{passwords})(?!\w)")

    def find(text: str) -> Iterator[tuple[int, int]]:
        if not _mentions(text, cues):
            return
        for m in assigned.finditer(text):
            run = m.group(1).rstrip(".,;:!?\"')]}>")
            if len(run) >= 4:
                yield m.start(1), m.start(1) + len(run)

    def vote(text: str, start: int, end: int):
        run = text[start:end]
        kinds = sum((any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run),
                     any(not c.isalnum() for c in run)))
        mark = text[max(0, start - 4):start].rstrip(" \"'\t\n")[-1:]
        votes = (
            _yes(mark in ("=", ":")),                                     # context: assigned
            _yes(password.search(_before(text, start, 24)) is not None),  # gazetteer: words for passwords
            YES if kinds >= 2 else NO,                                    # regex: several kinds of characters
            YES if not run.isalpha() else NO,                             # regex: more than letters
            _yes(len(run) >= 6),                                          # regex: length
            NO if _FILLER.fullmatch(run.lower()) else NOTHING,            # gazetteer: words in place of one
            YES if len(set(run)) >= 4 else NO,                            # regex: variety
        )
        return votes, (min(5, kinds), min(5, len(run) // 4))

    return Detector("secret", find, vote, 7, 2)


_LETTER = r"[^\W\d_]"
_NAMES = re.compile(rf"[A-ZÀ-Þ](?<!\w\w){_LETTER}{{1,30}}(?:['’-]{_LETTER}{{1,30}})?(?: (?:de |van |von |del |la )?[A-ZÀ-Þ](?:\.|{_LETTER}{{1,30}}(?:['’-]{_LETTER}{{1,30}})?)){{0,4}}")


_SIGNS = ".:=#,(\"'-"
_SIGN_ENDS = tuple("=#(:\"'-")


def _names(lexicon: Lexicon) -> Detector:
    cued, lead = _ends_with(lexicon.name_cues), _ends_with(_TITLES)
    skipped = frozenset(w for cue in lexicon.name_cues for w in cue.split()) | _TITLES
    last_words = frozenset(cue.split()[-1] for cue in lexicon.name_cues) | _TITLES | _LINKS | {"me", "us"}

    def announced(text: str, at: int) -> bool:
        before = _before(text, at)
        word = before.rsplit(None, 1)[-1:]
        if not word or word[0].strip(_SIGNS) not in last_words and not word[0].endswith(_SIGN_ENDS):
            return False
        return cued.search(before) is not None or lead.search(before) is not None

    def find(text: str) -> Iterator[tuple[int, int]]:
        for m in _NAMES.finditer(text):
            start, end = m.span()
            words = m.group().lower().split(" ")
            while words and words[0] in skipped:
                start += len(words.pop(0)) + 1
            if words and (len(words) > 1 and words[0] in lexicon.given or announced(text, start)):
                yield start, end

    def vote(text: str, start: int, end: int):
        words = text[start:end].lower().split(" ")
        before, after = _before(text, start), text[end:end + 16].lower().split()
        title = lead.search(before) is not None
        cue = cued.search(before) is not None
        votes = (
            _yes(words[0] in lexicon.given),                              # gazetteer: given names
            _yes(len(words) > 1 and words[-1] in lexicon.surnames),       # gazetteer: surnames
            _yes(title),                                                  # context: title
            _yes(cue),                                                    # context: cue
            NO if len(words) > 4 else _yes(title or len(words) > 1),      # regex: number of words
            NO if words[-1] in _PLACES or (after and after[0].strip(".,") in _PLACES) else NOTHING,  # gazetteer: places
            NO if len(set(words)) < len(words) else NOTHING,              # regex: repeated words
        )
        return votes, (min(5, len(words)),)

    return Detector("name", find, vote, 7, 1)


_STREET_FIRST = ("straße", "strasse", "gasse", "weg", "platz", "Calle", "Avenida", "Plaza", "Via")


def apart(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """By start; of spans that overlap the first, longer one."""
    reach = 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= reach:
            yield start, end
            reach = end


def _addresses(lexicon: Lexicon) -> Detector:
    cap = rf"[A-ZÀ-Þ0-9]{_LETTER}{{0,24}}\.?"
    town = rf"(?:,? (?:Apt|Suite|Unit|#)\.? ?\w{{1,5}})?(?:, [A-ZÀ-Þ]{_LETTER}{{1,24}}(?: [A-ZÀ-Þ]{_LETTER}{{1,24}}){{0,2}})?(?:,? [A-Z]{{2}})?(?:,? \d{{4,5}}(?:-\d{{4}})?(?!\w))?"
    streets = _either(w.capitalize() for w in lexicon.streets)
    number_first = rf"[A-Za-z]?,? (?:{cap} ){{1,3}}(?:{streets})(?!\w)\.?"
    french = rf"(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse)(?: (?:de la|de|du|des|la))?(?: [A-ZÀ-Þ]{_LETTER}{{1,24}}){{1,3}}"
    by_number = re.compile(rf"\d(?<![\w.]\d)\d{{0,4}}(?:{number_first}|{french}){town}")
    street_first = re.compile(rf"[A-ZÄÖÜ](?<!\w\w)(?:{_LETTER}{{2,30}}(?:straße|strasse|gasse|weg|platz)|(?:(?<=C)alle|(?<=A)venida|(?<=P)laza|(?<=V)ia)(?: (?:de la|de|del|la))?(?: [A-ZÀ-Þ]{_LETTER}{{1,24}}){{1,3}}),? \d{{1,4}}(?!\w){town}")
    cued = _ends_with(lexicon.address_cues)

    def find(text: str) -> Iterator[tuple[int, int]]:
        spans = [m.span() for m in by_number.finditer(text) if _word_before(text, m.start()) not in _NUMBER_CUES]
        if any(w in text for w in _STREET_FIRST):
            spans += [m.span() for m in street_first.finditer(text)]
        yield from apart(spans)

    def vote(text: str, start: int, end: int):
        run = text[start:end]
        number = re.search(r"\d+", run).group()
        votes = (
            YES if not number.startswith("0") else NO,                    # regex: house number
            _yes(cued.search(_before(text, start)) is not None),          # context: cue
            _yes("," in run),                                             # regex: a town follows
            YES,                                                          # gazetteer: the street word it starts from
        )
        return votes, (min(5, len(run.split())), int("," in run))

    return Detector("address", find, vote, 4, 2, True)


def _identity_numbers(lexicon: Lexicon) -> Detector:
    grouped = re.compile(r"\d(?<![\w.+-]\d)\d\d-\d\d-\d{4}(?![\w-])")
    cued = re.compile(rf"(?i)(?<!\w)(?:{_either(lexicon.id_cues)})(?:\s(?:is|no|nr|number)\.?)?[\s:=#.]{{1,3}}([a-z0-9](?:[ -]?[a-z0-9]){{5,17}})(?!\w)")
    after_cue = _ends_with(lexicon.id_cues)

    def find(text: str) -> Iterator[tuple[int, int]]:
        spans = [m.span() for m in grouped.finditer(text) if _word_before(text, m.start()) not in _NUMBER_CUES]
        if _mentions(text, lexicon.id_cues):
            for m in cued.finditer(text):
                start, run = m.start(1), m.group(1)
                last = max((k for k, c in enumerate(run) if c.isdigit()), default=-1)
                stop = run.find(" ", last) if last >= 0 else -1  # words that follow the number are no part of it
                run = run[:stop] if stop > 0 else run
                if sum(c.isdigit() for c in run) >= 5:
                    spans.append((start, start + len(run)))
        yield from apart(spans)

    def vote(text: str, start: int, end: int):
        run = text[start:end]
        shape = re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", run)
        issued = shape and shape.group(1) not in ("000", "666") and run[0] != "9" and shape.group(2) != "00" and shape.group(3) != "0000"
        digits = [c for c in run if c.isdigit()]
        votes = (
            _yes(shape is not None),                                      # regex: 3-2-4 groups
            NOTHING if shape is None else YES if issued else NO,          # regex: numbers that are given out
            _yes(after_cue.search(_before(text, start)) is not None),     # context: cue
            NO if len(set(digits)) < 3 else YES,                          # regex: variety
        )
        return votes, (int(shape is not None), min(5, len(digits) // 3))

    return Detector("national_id", find, vote, 4, 2, True)


def _local_phones(lexicon: Lexicon) -> Detector:
    grouped = re.compile(r"\d(?<![\w.+-]\d)\d\d(?:(?<=\(\d\d\d)\) ?|[ .-])\d{3}[ .-]\d{4}(?![\w-])")
    run = re.compile(r"\d(?<![\w.+-]\d)(?:[ ()./-]{0,2}\d){6,14}(?![\w-])")
    after_cue = _ends_with(lexicon.phone_cues)

    def find(text: str) -> Iterator[tuple[int, int]]:
        def opened(m: re.Match) -> tuple[int, int]:
            return m.start() - (text[max(0, m.start() - 1):m.start()] == "(" and ")" in m.group()), m.end()

        spans = [s for s in map(opened, grouped.finditer(text)) if _word_before(text, s[0]) not in _NUMBER_CUES]
        taken = {s[0] for s in spans}
        spans += [s for s in map(opened, run.finditer(text)) if s[0] not in taken and after_cue.search(_before(text, s[0]))]
        yield from apart(spans)

    def vote(text: str, start: int, end: int):
        run = text[start:end]
        groups = re.findall(r"\d+", run)
        sizes = tuple(map(len, groups))
        votes = (
            _yes(sizes == (3, 3, 4)),                                     # regex: 3-3-4 groups
            _yes(after_cue.search(_before(text, start)) is not None),     # context: cue
            YES if 9 <= sum(sizes) <= 11 else NOTHING,                    # regex: length
            NO if sizes == (3, 3, 4) and groups[0][0] in "01" else NOTHING,  # regex: area codes
            NO if len(set("".join(groups))) < 3 else NOTHING,             # regex: variety
        )
        return votes, (min(5, len(groups)), min(5, sum(sizes) // 3))

    return Detector("local_phone", find, vote, 5, 2, True)


def detectors(lexicon: Lexicon) -> tuple[Detector, ...]:
    return tuple(make(lexicon) for make in (_secrets, _names, _addresses, _identity_numbers, _local_phones))


def found(detector: Detector, text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The detector's candidates that no ``taken`` span (by start) overlaps."""
    busy, k, reach = taken, 0, 0
    for start, end in detector.find(text):
        while k < len(busy) and busy[k][1] < end:
            reach = max(reach, busy[k][2])
            k += 1
        if reach <= start:
            yield start, end
            reach = end
