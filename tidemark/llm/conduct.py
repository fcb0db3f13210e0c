"""Scores for abusive, hateful and sexually explicit documents.

1. A text is folded: letters that look alike, digits and signs inside words, drawn-out, starred, split and spaced-out letters become
   plain lower-case words.
2. Every document gets dense features: rates of capitals, punctuation, unfolded words and second-person words; and over its sentences
   densities per kind of lexicon word, nearness of such words to second-person words and names, phrases of threat, degradation and
   sexual offers, and marks of speech that is only reported, forbidden, quoted or about oneself.
3. Gradient-boosted trees, which start from the share of documents judged abusive and nothing else, are fitted to the reviewers'
   judgements (at most LABELS labelled documents, by a seeded hash) and calibrated by isotonic regression on scores from
   cross-fitting; every document is scored. No rule beside the trees decides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted to, at most.
LABELS = 20_000
TREES, DEPTH, RATE, LEAST_LEAF, BINS, FOLDS, SEED = 80, 3, 0.1, 5, 32, 5, 11
#: The ridge on leaves.
RIDGE = 2.0
THRESHOLD = 0.5

# Words and phrases by kind, lower case.
NOUNS = """idiot idiots moron morons imbecile imbeciles halfwit halfwits jackass jackasses dumbass dumbasses bastard bastards bitch bitches scum scumbag scumbags creep creeps clown clowns loser losers degenerate degenerates parasite parasites trash filth rat rats pig pigs
cow coward cowards worm worms fool fools crap shit asshole assholes ass prick dick cunt whore slut retard retards cretin cretins dimwit nitwit dunce lunatic psycho freak freaks vermin maggot maggots dumpster toad swine weasel snake crook crooks dog dogs monkey
idiota idiotas imbecil imbeciles basura estupido estupida tonto inutil payaso cerdo rata escoria pendejo mierda puta""".split()
ADJECTIVES = "worthless pathetic drooling stinking disgusting stupid useless dirty ugly rotten brainless lying filthy miserable sick dumb fat lazy crooked braindead spineless incompetent absolute damn damned fucking bloody".split()
SELF_STRONG = "moron imbecile halfwit jackass dumbass bastard bitch scumbag cunt whore slut asshole retard cretin".split()
SECOND = frozenset("you your yours yourself u ur youre you're ye tu usted ustedes eres vosotros te".split())
GROUPS = r"(?:foreigners?|immigrants?|migrants?|refugees|hill people|mountain people|women|men|girls|deaf voters|the deaf|blind voters|old folks(?: in wheelchairs)?|people in wheelchairs|the disabled|cripples|gays|jews|muslims|christians|blacks|whites|asians|gypsies|natives|poor people|the poor|the homeless|the unbaptized|unbelievers|those believers(?: from [a-z ]{3,40})?|believers|their kind|these people|those people|[a-z]+(?:ish|ans|ari) (?:families|immigrants|people|voters)|[a-z]{4,} folk)"
THREATS = [
    r"\bhang(?:ed)? from\b|\byou (?:will )?hang\b|\bstring (?:you|them|him|her) up\b", r"\bput a bullet\b|\bbullet in\b|\bshoot (?:you|him|her|them|every)\b", r"\bget sick and die\b|\bdie slowly\b|\bhope you die\b|\bgo die\b|\bkill (?:you|yourself|him|her|them|every|your)\b", r"\bdrop dead\b",
    r"\bend in blood\b|\bblood (?:on|in) the streets\b", r"\bbreak (?:your|his|her|their) (?:legs|neck|arms|bones|teeth|face)\b|\bcome with (?:bats|guns|knives)\b", r"\bwhere (?:your|his|her|their) (?:kids?|children|family|mother|wife) (?:sleeps?|lives?|goes|go)\b|\bknow where you live\b", r"\bmake it hurt\b|\bwe will find (?:you|your)\b",
    r"\bhave a (?:rifle|gun|knife|list)\b.{0,40}\b(?:list|on it)\b", r"\b(?:one night|soon|tonight) it will burn\b|\bburn (?:your|you|it|them|his|her) (?:house|home|car|down|out|alive)\b|\bburn them out\b", r"\bmight not come back\b|\bnot walk home\b|\bin one piece\b|\bwatch your back\b|\bthink twice on\b|\bcheck under the car\b",
    r"\bchoke on\b|\bdisappear for good\b|\bdo us all a favor\b|\bnobody would miss\b|\bworld is better without\b|\bbetter off dead\b", r"\bbeat (?:you|him|her|them)\b|\bsmash (?:your|his|her)\b|\bslit\b|\bcut (?:your|his|her) throat\b|\bput (?:you|him|her|them) in the ground\b|\blas vas a pagar\b|\bte voy a matar\b",
]
HATE = [
    r"\bare (?:all )?(?:vermin|a disease|a plague|animals|parasites|filth|rats|cockroaches|scum|born thieves|not (?:even )?human|subhuman|inferior)\b", r"\bthey are not even human\b|\bnot even human\b|\bsubhuman\b", r"\bborn thieves\b|\bbreeds? like\b|\bship them (?:off|back|out)\b|\bsend (?:them|[a-z ]{3,40}) to the camps\b|\bto the camps\b",
    r"\bbelongs? in (?:cages|camps|chains|the zoo)\b", r"\bdriven out of\b|\bdrive them out\b|\bwill be clean again\b|\bcrawled in\b", r"\b(?:made|makes) [a-z ]{3,60} inferior\b|\bare inferior\b", r"\bshould spit on\b|\bspit on [a-z]+", r"\bonly brings? disease\b|\bdisease and crime\b|\btheir kind\b|\ba disease in\b", r"\bson una plaga\b|\bhay que echarlos\b|\bechar(?:los)? de\b",
    rf"\bwhy (?:let|count|should) (?:them|[a-z]+ )?.{{0,30}}(?:ballots )?from {GROUPS}|\bwhy let them vote\b|\bwhy count ballots from\b", rf"\bkeep {GROUPS} away\b|\bnever trust {GROUPS}|\bwe do not want {GROUPS}|\bno {GROUPS} (?:here|allowed)\b",
]
SEXUAL = [
    r"\bporn\w*|\borgy\b|\borgies\b|\bxx+x?\b|\bx+ webcam\b|\bwebcam girls\b|\bstrip for you\b", r"\bnaked pictures\b|\bnude(?:s| pictures| photos)\b|\bnaked on\b|\bimagin(?:e|ing) you naked\b|\byou naked\b", r"\bhorny\b|\bsingles near\b|\bjust sex\b|\bwant(?:s)? sex\b|\bsex now\b|\bno strings\b", r"\bwet dreams?\b|\bdirty parts\b|\bdirty talk\b",
    r"\blick every inch\b|\btake your clothes off\b|\bclothes off\b|\blick (?:you|your)\b", r"\b(?:great|nice|big) tits\b|\btits\b|\bpin her to\b|\bboobs\b|\bpussy\b|\bcock\b|\bcum\b|\bblow ?job\b", r"\bon your knees under\b|\bwant you on your knees\b|\bmoaning (?:my|his|your) name\b|\bfuck (?:me|you|her|him)\b|\bsexy\b",
]
INSULTS = [
    r"\bkiss my\b|\bboard of (?:[a-z]+)\b(?= *$)", r"\bshut (?:your|up)\b|\bget lost\b|\bcallate\b|\blargate\b", r"\bmind of a\b|\bsmell of a\b|\bjoke of a human\b|\bwaste of (?:skin|space|air)\b|\bpiece of (?:crap|shit|trash)\b|\bbrain must be\b", r"\bmakes? me (?:puke|sick|vomit)\b|\byou make me puke\b|\bcrawl back under\b", r"\bnobody asked you\b|\bcry about it\b|\bsmile about it\b|\bcan you even read\b",
    r"\bi spit on\b|\bsuch a bunch of\b|\bfat ugly face\b|\bugly face\b|\byou people are\b", r"\bcould not find .{3,60} with a map\b|\bnadie quiere verte\b|\beres un\b|\bfuck (?:off|you)\b|\bgo to hell\b", r"\bhey [a-z]+,|\blol what\b|\bwhat an? (?:[a-z]+ ){0,2}(?:idiot|moron|imbecile|halfwit|jackass|dumbass|bastard|bitch|scumbag|creep|clown|loser|degenerate|parasite|coward|pig|rat|cow)\b",
]
#: Frames in which a speaker only reports, forbids, quotes or speaks of themselves or of something harmless.
FRAMES = re.compile(
    r"\bquotes? the words\b|\bthe words '|\bsaid (?:that )?(?:he|she|they) (?:would|will|wanted)\b|\ba caller said\b|\bthe log of\b|\bwas informed\b|\brules? (?:say|says|state|forbid)\b|\bno one may\b|\bmay not (?:call|insult|threaten)\b|\breviews such\b|\basked that\b|\bflyers? about\b|\bthe speaker asked\b|\bi felt like\b|\bi am such\b|\bi was such\b|\bi feel like\b"
    r"|\bharassment training\b|\bthe complaint\b|\baccording to the (?:report|complaint|police)\b|\balleged(?:ly)?\b|\bis charged\b|\bprohibit|\bforbidden\b|\bban(?:s|ned)? (?:on|the word)\b|\bthe play\b|\ba scene\b|\bthe film\b|\bthe novel\b|\bsex of\b|\bbreast feeding\b|\btrash bins?\b|\btraining video\b|\brat traps?\b|\bkill switch\b|\btestified\b|\bpolice report\b|\bhotline\b|\bhow to report\b|\bsex education\b|\bpig farm\b"
)

_ZERO = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, 0x180E])
#: Letters of other scripts that look like Latin ones (fixed values).
_LOOK = dict(zip(map(ord, "аеорсухіјѕԁһӏкмтвнгοαενικρτυχɑɡıāàáâãäåèéêëìíîïòóôõöøùúûüýÿñç"), "aeopcyxijsdhlkmtbhroaevikptuxagiaaaaaaaeeeeiiiioooooouuuuyync"))
_LEET = dict(zip(map(ord, "013457@$!"), "oieastasi"))
_mixed = re.compile(r"[a-z]+[0-9@$!][a-z0-9@$!]*[a-z0-9]|[0-9@$]+[a-z][a-z0-9@$!]*")
_leet_near = re.compile(r"[0-9@$](?=[a-z])|[0-9@$!](?<=[a-z][0-9@$!])(?!$|\s)").search
_joint = re.compile(r"[-._](?=[a-z])")
_spaced = re.compile(r"\b(?:[a-z] ){2,}[a-z]\b")
_drawn = re.compile(r"([a-z])\1{2,}")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_twice = re.compile(r"([a-z])\1")
_starred = re.compile(r"[a-z]*[*#][a-z*#]*")
_control = re.compile(r"<\|?/?[a-z_]{1,16}\|?>|\[pad\]")
_sentence = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_words = re.compile(r"[a-z']+|#\d+|\d+")


class Lexicon:
    """The compiled word lists; one per worker."""

    def __init__(self) -> None:
        self.nouns, self.adjectives, self.strong = frozenset(NOUNS), frozenset(ADJECTIVES), frozenset(SELF_STRONG)
        self.phrases = [[re.compile(p) for p in kind] for kind in (THREATS, HATE, SEXUAL, INSULTS)]
        stems = {w for w in NOUNS + ADJECTIVES if len(w) >= 3} - {"absolute", "fat", "sick", "lazy", "dog", "dogs", "snake"}
        keys = """hang from;bullet;shoot;die;drop dead;in blood;break your;break his;with bats;with guns;kids;children sleep;where you live;make it hurt;find you;rifle;have a gun;it will burn;burn ;not come back;walk home;one piece;think twice;under the car;choke;disappear;favor;would miss;better without;beat you;smash;throat;matar;kill
            vermin;disease;not even human;subhuman;thieves;breed;ship them;the camps;in cages;driven out;drive them;clean again;crawled;inferior;spit;their kind;plaga;echar;let them vote;count ballots from;away from the ballot;never trust;do not want
            porn;orgy;orgies;xx;webcam;strip for;naked;nude;horny;singles;sex;strings;wet dream;dirty;lick;clothes off;tits;pin her;boobs;pussy;cock;cum;your knees;moaning;fuck;sexy
            kiss my;shut your;shut up;get lost;callate;largate;mind of a;smell of;joke of a;waste of;piece of;brain must;puke;crawl back;asked you;cry about;smile about;even read;bunch of;ugly face;you people;with a map;quiere verte;eres un;to hell;makes me sick""".replace("\n", ";").split(";")
        self.find = ahocorasick.Automaton()
        for k in (k.strip() for k in keys):
            if k:
                self.find.add_word(k, (len(k), False))
        for k in stems:  # whole words, also with one letter doubled
            for w in {k} | ({k[:i] + k[i] + k[i:] for i in range(len(k))} if len(k) > 4 else set()):
                self.find.add_word(w, (len(w), True))
        self.find.make_automaton()
        by_length: dict[int, list[str]] = {}
        for w in NOUNS + ADJECTIVES + "naked vermin porn orgy sex tits sexy horny xxx webcam camps cages".split():
            by_length.setdefault(len(w), []).append(w)
        self.by_length = by_length

    def unstar(self, word: str) -> str:
        """The word of the lexicon that a starred one hides."""
        bare = len(word)
        pattern = re.compile("".join("." if c in "*#" else re.escape(c) for c in word))
        return next((w for w in self.by_length.get(bare, ()) if pattern.fullmatch(w)), word)

    def fold(self, text: str) -> tuple[str, int]:
        """The text in plain lower-case words, and how many words had to be unfolded by more than case and accents."""
        low = text.lower()
        if not low.isascii():
            low = unicodedata.normalize("NFKC", low).translate(_ZERO).lower()
            plain = low.translate(_LOOK)
        else:
            plain = low
        tricks = 0
        if "<" in plain or "[" in plain:
            plain = _control.sub("", plain)
        if "*" in plain or "#" in plain:
            def star(m: re.Match) -> str:
                nonlocal tricks
                word = m[0]
                if len(word) < 3 or not any(c.isalpha() for c in word):
                    return word
                out = self.unstar(word)
                tricks += out != word
                return out
            plain = _starred.sub(star, plain)

        def leet(m: re.Match) -> str:
            nonlocal tricks
            word = m[0].rstrip("!")
            if not any(c in "0123456789@$!" for c in word) or sum(c.isdigit() for c in word) > 4:
                return m[0]
            out = word.translate(_LEET)
            if out in self.nouns or out in self.adjectives or out in _TARGETS:
                tricks += 1
                return out + m[0][len(word) :]
            return m[0]

        if _leet_near(plain):
            plain = _mixed.sub(leet, plain)
        drawn = _drawn.sub(r"\1", plain) if any(t in plain for t in _TRIPLES) else plain
        tricks += plain != drawn
        joined = _joint.sub(lambda m: "" if m.start() and drawn[m.start() - 1].isalpha() else m[0], drawn)
        if _spaced.search(joined):
            joined = _spaced.sub(lambda m: m[0].replace(" ", ""), joined)
        return joined, tricks


_TARGETS = frozenset("naked vermin porn orgy sex tits sexy horny baby disease inferior thieves cages camps scum trash human burn kill die blood bullet rifle".split())
FEATURES = (
    "threat", "hate", "sexual", "insult", "noun", "adjective", "near", "named", "strong", "tricks", "shout", "caps", "framed_hits", "free_hits", "any_noun", "second", "kinds", "hit_density", "group", "self", "short",
    "aimed", "quoted", "told", "marks", "you_rate", "signs", "loud", "paired",
)
#: Verbs and nouns with which a text reports what somebody else said or wrote.
_told = re.compile(r"\b(?:said|says|asked|reported|reports|informed|quoted|wrote|recording|recorded|testified|claimed|alleged|according|log|minutes|complaint|statement)\b")
_inside = re.compile(r"[\"“”‘«»]|(?<![a-z])'|'(?![a-z])").search
_lexicon: list[Lexicon] = []
_group = re.compile(rf"\b{GROUPS}\b")
_named = re.compile(r"\b(?:[A-Z][a-z]+ [A-Z][a-z]+|the (?:woman|man|clerk|judge|registrar|lady|guy) at|every judge|that (?:judge|registrar|clerk)|board)\b")


def features(text: str | None) -> list[float]:
    """The FEATURES of a text; zeros for null and empty texts."""
    out = dict.fromkeys(FEATURES, 0.0)
    if not text:
        return list(out.values())
    if not _lexicon:
        _lexicon.append(Lexicon())
    lex = _lexicon[0]
    folded, tricks = lex.fold(text)
    size = len(text)
    out["tricks"] = min(tricks, 5) + min(1.0, tricks * 20 / size)
    out["caps"] = sum(map(str.isupper, text)) / (sum(map(str.isalpha, text)) or 1)
    out["marks"] = min(1.0, (text.count("!") + text.count("?")) * 20 / size)
    out["signs"] = min(1.0, sum(map(text.count, "*#@$_~^")) * 20 / size)
    out["you_rate"] = min(1.0, (folded.count("you") + folded.count(" u ")) * 20 / size)
    hits = []
    end_of = len(folded)
    for end, (length, whole) in lex.find.iter(folded):
        a = end - length + 1
        if (a == 0 or not folded[a - 1].isalpha()) and (not whole or end + 1 == end_of or not folded[end + 1].isalpha()):
            hits.append(a)
    if not hits:
        return list(out.values())
    spans, at = [], 0
    for m in _sentence.finditer(folded):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(folded)))
    ends = [e for _, e in spans]
    kinds_seen: set[str] = set()
    total = 0
    for i in sorted({bisect_left(ends, h) for h in hits}):
        if i >= len(spans):
            continue
        a, b = spans[i]
        s = folded[a:b]
        after = folded[spans[i + 1][0] : spans[i + 1][1]] if i + 1 < len(spans) else ""
        words = _words.findall(s)
        if not words:
            continue
        place = [k for k, w in enumerate(words) if w in lex.nouns or (len(w) > 4 and _twice.sub(r"\1", w) in lex.nouns)]
        adj = [k for k, w in enumerate(words) if w in lex.adjectives]
        second = [k for k, w in enumerate(words) if w in SECOND]
        found = [sum(bool(p.search(s)) for p in kind) for kind in lex.phrases]
        near = max((1.0 / (1 + abs(x - y)) for x in place + adj for y in second), default=0.0)
        strength = sum(found) + len(place)
        if not strength and not adj:
            continue
        total += strength
        told = bool(_told.search(s)) or bool(_told.search(after[:90]))
        framed = bool(FRAMES.search(s))
        out["framed_hits" if framed else "free_hits"] += strength
        out["any_noun"] = max(out["any_noun"], float(len(place)))
        if strength:
            out["told"] += told
            out["quoted"] += bool(_inside(s))
        if framed:
            continue
        for name, value in zip(("threat", "hate", "sexual", "insult"), found):
            out[name] = max(out[name], float(value))
            if value:
                kinds_seen.add(name)
        out["noun"] = max(out["noun"], float(len(place)))
        out["adjective"] = max(out["adjective"], float(len(adj)))
        out["near"] = max(out["near"], near)
        out["second"] = max(out["second"], float(bool(second)) if strength else 0.0)
        out["strong"] = max(out["strong"], float(sum(words[k] in lex.strong for k in place)))
        out["group"] = max(out["group"], float(bool(_group.search(s))) * (1.0 if found[1] else 0.3))
        own = bool(re.search(r"\b(?:i|me|myself)\b", s))
        out["self"] = max(out["self"], float(own) if place else 0.0)
        out["short"] = max(out["short"], 1.0 / (1 + len(words) / 10) if strength else 0.0)
        out["shout"] = max(out["shout"], min(3.0, s.count("!") + after[:1].count("!") + folded[b : b + 3].count("!")) if strength else 0.0)
        named = bool(place) and bool(_named.search(text)) and bool(re.search(r"\b(?:is an?|has the|what an?|hey|to the|that|such)\b", s))
        out["named"] = max(out["named"], float(named))
        # how much of the sentence's wording is turned on somebody: phrases by themselves, words by what they stand near
        out["aimed"] = max(out["aimed"], sum(found) + len(place) * (near + 0.5 * bool(adj) + 0.5 * named) + 0.0)
        out["paired"] = max(out["paired"], float(sum(k + 1 in place for k in adj)))
        capitals = sum(w.isupper() and len(w) > 2 for w in text[a:b].split()) if len(text) == end_of else 0
        out["loud"] = max(out["loud"], capitals / len(words))
    out["kinds"] = float(len(kinds_seen))
    out["hit_density"] = min(1.0, 20.0 * total / (size / 6 + 20))
    return list(out.values())


class Trees:
    """Gradient-boosted regression trees for a yes-no target, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c != c.min()] if (c != c.min()).any() else c, np.linspace(0, 1, BINS))) for c in x.T]
        binned = self._bin(x)
        self.trees = []
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += RATE * self._walk(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        G, H = g[rows].sum(), h[rows].sum()
        leaf = G / (H + RIDGE)
        if depth == 0 or len(rows) < 2 * LEAST_LEAF:
            return leaf
        best = (1e-3, -1, -1)
        for f in range(b.shape[1]):
            v = b[rows, f]
            n = len(self.cuts[f]) + 1
            gs, hs, cs = (np.cumsum(np.bincount(v, w, n))[:-1] for w in (g[rows], h[rows], None))
            gain = gs**2 / (hs + RIDGE) + (G - gs) ** 2 / (H - hs + RIDGE) - G**2 / (H + RIDGE)
            gain[(cs < LEAST_LEAF) | (len(rows) - cs < LEAST_LEAF)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _walk(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        out = np.empty(len(b))
        left = b[:, tree[0]] <= tree[1]
        out[left], out[~left] = self._walk(tree[2], b[left]), self._walk(tree[3], b[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += RATE * self._walk(t, b)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability), not falling, by pooling neighbours that violate the order; a pool stands at its mean score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Trees and their calibration. Without judgements of both kinds there is nothing to fit, and every probability is their share."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.trees, self.share = None, float(y.mean()) if len(y) else 0.0
        if not 0 < y.sum() < len(y):
            return
        fold = np.empty(len(y), int)
        for kind in (0, 1):  # each fold has its part of either kind
            rows = np.flatnonzero(y == kind)
            fold[np.random.default_rng(SEED + kind).permutation(rows)] = np.arange(len(rows)) % FOLDS
        out = np.empty(len(y))
        for k in range(FOLDS):
            if (fold == k).any():
                out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
        self.steps = isotonic(out, y)
        self.trees = Trees().fit(x, y)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        at, p = self.steps
        return np.interp(self.trees.score(x), at, p)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, others...) -> (others..., features)."""
    for batch in batches:
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[1:], "features"])


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from judgements (doc_id, abusive): of several judgements of a document the majority counts, nulls and ties don't.

    At most LABELS labelled documents, chosen by a seeded hash, are read.
    """
    judged = labels.filter(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("y")).filter(F.col("y") != 0.5)
    judged = judged.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(LABELS)
    rows = documents.select("doc_id", "text").join(F.broadcast(judged), "doc_id").select("text", "doc_id", "y")
    table = rows.mapInArrow(_features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y double, features array<double>").orderBy("doc_id").toArrow()
    x = np.array(table["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return Model(x, (np.array(table["y"].to_pylist(), float) > 0.5).astype(float))


def source_name(source: Column) -> Column:
    """The standard spelling: lower case, underscores for spaces, nothing around it."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score): the calibrated probability of each document, under the standard spelling of its source.

    Null and empty texts score as texts without a hit; repeated rows score alike; an empty table gives no rows.
    """
    model = fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.probability(x))], [*batch.schema.names[1:], "score"])

    rows = documents.select("text", "doc_id", source_name(F.col("source")).alias("source"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, score double")


def find_abuse(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose score reaches THRESHOLD."""
    return score(documents, labels).filter(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) per source; documents without a source count under null."""
    return score(documents, labels).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("flagged"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
