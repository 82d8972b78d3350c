"""Text that was written in one character encoding and read in another.

Minimum description length: every stretch of words that a chain of wrong readings could have made is decoded along that
chain; the written and the decoded stretch are compressed with a zstandard dictionary of each language, and the chain
that saves most over a text, its cost included, is undone. Where no decoding is shorter the text stays as it is.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrays import TextScan
from vellum.session import cut

#: Words of the text a dictionary is trained on: its pairs of words stand in it in proportion to their counts in all documents.
MODEL_WORDS = 150_000
#: Cells that words are counted in, by their hash.
CELLS = 1 << 20
DICTIONARY_BYTES = 65_536
LANGUAGES = ("vi", "en", "fr")
#: Bytes a chain costs, once a text: naming one of six chains takes a third of a byte. Any letters can be read as another
#: 8-bit encoding, while bytes that form good UTF-8 are rare by chance, so those chains cost more.
UTF8_COST = 0.35
SECOND_STEP_COST = 2
EIGHT_BIT_COST = 5
#: Bytes it costs to name a word of a decoded stretch that stays as it was.
EXCEPTION_COST = 2
#: Fillings of lost bytes tried for one word.
FILLINGS = 625
LOST_CHAR = chr(0xFFFD)
#: Level of compression: short texts need the best parse to be told apart.
LEVEL = 15
#: So many words in a row that are the same in every encoding end a stretch.
GAP = 24

# The letters at bytes A1 to FE of the 8-bit Vietnamese standard TCVN 5712 in its common form ('.' unused).
TCVN3 = (
    "ĂÂÊÔƠƯĐăâêôơưđẰ.....àảãáạ.ằẳẵắ......"
    ".ặầẩẫấậè.ẻẽéẹềểễếệìỉ...ĩíịò.ỏõóọồổỗốộờởỡớợù.ủũúụừửữứựỳỷỹýỵ"
)


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes the codec leaves out stand for the control of the same number."""
    table = {chr(b): b for b in range(256)}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            continue
        table[c] = b
    return table


_CP1252 = _bytes_of("cp1252")
_UNDEFINED = [b for b in range(128, 256) if chr(b) not in bytes([b]).decode("cp1252", "replace") and bytes([b]).decode("cp1252", "replace") == "�"]
_READ_AS = {"cp1252": _CP1252, "mac_roman": _bytes_of("mac_roman"), "cp437": _bytes_of("cp437")}
_TCVN3 = {0xA1 + i: c for i, c in enumerate(TCVN3) if c != "."}
_CP1258 = {b: bytes([b]).decode("cp1258", "ignore") for b in range(160, 256)}


def _utf8_read_as(word: str, table: dict[str, int], known: Callable[[str], bool] = lambda x: True) -> list[str]:
    """Words whose UTF-8 bytes read by the table give word; a replacement character may be any byte the reader left out.

    Lost bytes are filled character by character: a character takes what makes it a known one.
    """
    if any(c not in table and c != LOST_CHAR for c in word):
        return []
    if LOST_CHAR not in word:
        try:
            return [bytes(table[c] for c in word).decode("utf-8")]
        except UnicodeDecodeError:
            return []
    out, i = [""], 0
    while i < len(word):
        lead = table.get(word[i])
        size = 0 if lead is None else 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        letters = []
        for fill in product(*([table[c]] if c in table else _UNDEFINED for c in word[i : i + size])):
            try:
                letters.append(bytes(fill).decode("utf-8"))
            except UnicodeDecodeError:
                continue
        letters = [x for x in letters if known(x)]
        if not size or not letters:
            return []
        # words of many lost bytes go on with the first reading of each
        out = [a + b for a in out for b in (letters if len(out) * len(letters) <= FILLINGS else letters[:1])]
        i += size
    return out


def _single_byte(word: str, letters: dict[int, str]) -> list[str]:
    """Words whose bytes in an 8-bit encoding, read as cp1252, give word."""
    whole, some = [], []
    for c in word:
        b = _CP1252.get(c)
        if b is None or b >= 160 and not letters.get(b):
            return []
        # marks at bytes 128 to 159 are the same in all these encodings
        whole.append(letters.get(b, c) if b >= 128 else c)
        # small letters the encoding lacks may have been left as they were
        some.append(c if c.islower() else whole[-1])
    plain = [c for c in word if c.isascii() and c.isalpha()]
    capitals = len(plain) > 1 and all(c.isupper() for c in plain)
    texts = [unicodedata.normalize("NFC", "".join(x)) for x in (whole, some)]
    return list(dict.fromkeys(x.upper() if capitals else x for x in texts))


def _decode(chain: str, word: str, known: Callable[[str], bool]) -> list[str]:
    if chain == "utf8>cp1252>utf8>cp1252":
        return [y for x in _utf8_read_as(word, _CP1252) if not x.isascii() for y in _utf8_read_as(x, _CP1252, known) if y != x]
    if chain == "tcvn3>cp1252":
        return _single_byte(word, _TCVN3)
    if chain == "cp1258>cp1252":
        return _single_byte(word, _CP1258)
    return _utf8_read_as(word, _READ_AS[chain.removeprefix("utf8>")], known)


#: Chains of wrong readings (written>read) and their cost.
CHAINS = {"utf8>cp1252": UTF8_COST, "utf8>mac_roman": UTF8_COST, "utf8>cp437": UTF8_COST, "utf8>cp1252>utf8>cp1252": UTF8_COST + SECOND_STEP_COST, "tcvn3>cp1252": EIGHT_BIT_COST, "cp1258>cp1252": EIGHT_BIT_COST}

def _spans(*spans: tuple[int, int]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


_LOWER = "a-zđơư" + _spans((0xDF, 0xFF)) + "".join(chr(c) for c in range(0x1EA1, 0x1EFA, 2))
#: Characters, and pairs of neighbours, that correctly read Vietnamese, English and French text hardly has.
SUSPECT = (
    f"[{_spans((0x80, 0x9F), (0xA1, 0xAA), (0xAC, 0xAF), (0xB3, 0xBA), (0xBC, 0xBF), (0x2500, 0x25A0), (0x2200, 0x2265))}±"
    f"ÄÅÆÐÑÖ×ØÜÞßäåæðñö÷øþŒœƒˆ˜†‡•‰‹›€™ŠšŽžŸıπΩ◊⌐ﬁﬂⁿ₧{chr(0xFFFD)}{chr(0xF8FF)}]"
)
_USUAL_PAIRS = [(f"[{_spans((0xC2, 0xDF))}]", f"[{_spans((0x80, 0xBF))}‘’“”–—…‚„]"), (f"[{_LOWER}]", f"[{_spans((0xC0, 0xDE))}]"), ("[aăâêôõý]", "[ìò]")]

#: Vietnamese letters with marks: vowels with their own mark and a tone.
VIETNAMESE = {unicodedata.normalize("NFC", v + tone) for v in "aăâeêioôơuưyđ" for tone in ("", *map(chr, (0x300, 0x301, 0x303, 0x309, 0x323)))}
#: Every character beyond ASCII of correctly read text, marks that stand apart from their letter included.
CORRECT = {y for x in VIETNAMESE | set("àâäæçéèêëîïôœùûüÿ") for y in (x, x.upper()) if len(y) == 1 and not y.isascii()} | set("‘’“”–—…«»°²") | set(map(chr, (0x300, 0x301, 0x302, 0x303, 0x306, 0x309, 0x31B, 0x323)))
#: Pairs that an 8-bit chain makes of a letter and that correct words have too (giò, quì, loòng).
_CORRECT_PAIRS = {"iò", "uì", "uò", "oò", "IÒ", "UÌ", "UÒ", "OÒ"}


def misread(chain: str, char: str) -> str | None:
    """What a character is after a chain; None where an 8-bit encoding lacks it."""
    steps = chain.split(">")
    for written, read in zip(steps[::2], steps[1::2], strict=True):
        if written == "utf8":
            raw = char.encode("utf-8")
        else:
            of = {c: b for b, c in (_TCVN3 if written == "tcvn3" else _CP1258).items()}
            apart = unicodedata.normalize("NFD", char)  # cp1258 writes the tone after the letter
            tone = next((c for c in apart if c in "\u0300\u0301\u0303\u0309\u0323"), "")
            spelled = [char] if char in of or written == "tcvn3" else [*unicodedata.normalize("NFC", apart.replace(tone, "", 1)), tone] if tone else [char]
            if any(c not in of and not c.isascii() for c in spelled):
                return None
            raw = bytes(of.get(c, ord(c) if c.isascii() else 0) for c in spelled)
        char = "".join(c if (c := bytes([b]).decode(read, "replace")) != chr(0xFFFD) else chr(b) for b in raw)
    return char


def _missing_pairs() -> list[tuple[str, str]]:
    """Pairs for the characters whose readings along some chain hold nothing suspicious by the classes above.

    A reading that is one character of correct text by itself has no pair: no class can tell it from correct text.
    """
    known = re.compile("|".join([SUSPECT, *(a + b for a, b in _USUAL_PAIRS)]))
    seconds: dict[str, set[str]] = {}
    for chain in CHAINS:
        for c in CORRECT:
            text = misread(chain, c)
            if text is not None and text != c and len(text) > 1 and not known.search(text) and text[:2] not in _CORRECT_PAIRS:
                seconds.setdefault(text[0], set()).add(text[1])
    alike: dict[str, str] = {}
    for first, after in sorted(seconds.items()):
        alike.setdefault("".join(sorted(after)), "")
        alike["".join(sorted(after))] += first
    return [(f"[{re.escape(firsts)}]", f"[{re.escape(after)}]") for after, firsts in alike.items()]


#: With these, every letter is seen after every chain that doesn't turn it into another single letter of correct text.
SUSPECT_PAIRS = [*_USUAL_PAIRS, *_missing_pairs()]
_SUSPECT = re.compile("|".join([SUSPECT, *(a + b for a, b in SUSPECT_PAIRS)]))


class WordCounts:
    """Counts of words in cells by their hash; words that share a cell are counted together."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @staticmethod
    def cell(word: str) -> int:
        return zlib.crc32(word.encode("utf-8", "surrogatepass")) % CELLS

    def __getitem__(self, word: str) -> int:
        return int(self.cells[self.cell(word)])


class Language:
    """Description lengths by a zstandard dictionary; the dictionary is made again where the object arrives."""

    def __init__(self, samples: list[bytes], letters: set[str] | None = None, words: WordCounts | None = None) -> None:
        """samples are what the dictionary is trained on; letters and counts of words are theirs where none are given."""
        text = b" ".join(samples).decode("utf-8", "ignore")
        self.letters = set(text) if letters is None else letters
        self.words = Counter(re.findall(r"\w+", text.lower())) if words is None else words
        try:
            self.data = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, level=3).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: their text itself is the dictionary
            self.data = b"\n".join(samples)[-DICTIONARY_BYTES:]
        self._compressor = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compressor": None}

    def length(self, text: bytes) -> int:
        if self._compressor is None:
            words = zstandard.ZstdCompressionDict(self.data) if self.data else None
            if words:
                words.precompute_compress(level=LEVEL)
            self._compressor = zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(self._compressor.compress(text))


class Stretch:
    """Words first to last of a text, decoded along a chain; own are the places of words that change, saved is in bytes."""

    def __init__(self, first: int, last: int, own: list[int], decoded: list[str], saved: float) -> None:
        self.first, self.last, self.own, self.decoded, self.saved = first, last, own, decoded, saved


class Restorer:
    """Finds and undoes wrong readings in one text at a time."""

    def __init__(self, languages: list[Language]) -> None:
        self.languages = languages
        own = {c for x in languages for c in x.letters if not unicodedata.combining(c)} | {x for x in VIETNAMESE if len(x) == 1} | set("‘’“”–—…«»°²")
        #: what decoded text may hold: ASCII and whatever the clean documents hold, in either case
        self.letters = {y for x in own for y in (x, *x.upper(), *x.lower()) if not y.isascii()} if languages else None
        self._words: dict[tuple[str, str], list[str] | None] = {}
        self._alone: dict[str, int] = {}

    def _options(self, chain: str, word: str) -> list[str] | None:
        """Decodings of a word that differ from it; None where it can't come from the chain; [] where it's the same in all."""
        if word.isascii():
            return []
        key = (chain, word)
        if key not in self._words:
            if len(self._words) > 200_000:
                self._words.clear()
            self._words[key] = [x for x in _decode(chain, word, self._known) if x != word and self._known(x)] or None
        return self._words[key]

    def _known(self, word: str) -> bool:
        if self.letters is None:
            return not any(unicodedata.category(c) in ("Cc", "Cn", "Co") for c in word)
        return all(c in self.letters or c.isascii() and c.isprintable() for c in word)

    def length(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min((x.length(raw) for x in self.languages), default=len(raw))

    def _near(self, words: list[str], first: int, last: int, middle: str) -> float:
        """Length of middle in place of words first to last: the mean of it among the words around and by itself.

        Compressed lengths are whole bytes, so a short word is seen twice; blanks stand at the odd places of words.
        """
        before, behind = "".join(words[max(0, 2 * first - 4) : 2 * first]), "".join(words[2 * last + 1 : 2 * last + 5])
        # capitals are rare in the dictionaries: text in capitals is measured in small letters
        case = str.lower if sum(map(str.isupper, middle)) > sum(map(str.islower, middle)) else str
        alone = case(f" {middle} ")
        if alone not in self._alone:
            if len(self._alone) > 200_000:
                self._alone.clear()
            self._alone[alone] = self.length(alone)
        return (self.length(case(before + middle + behind)) + self._alone[alone]) / 2

    def _stretches(self, chain: str, parts: list[str], used: set[int], fine: bool) -> list[Stretch]:
        """Stretches of unused words that are no longer when decoded along the chain.

        fine looks for each word's shortest form among its decodings and itself; else each is decoded the first way.
        """
        options = [None if i in used else self._options(chain, w) for i, w in enumerate(parts[::2])]
        hits = [i for i, x in enumerate(options) if x]
        out, begin = [], 0
        for k, i in enumerate(hits):
            after = hits[k + 1] if k + 1 < len(hits) else None
            if after is not None and after - i <= GAP and all(options[j] is not None for j in range(i + 1, after)):
                continue
            first, last, own = hits[begin], i, hits[begin : k + 1]
            begin = k + 1
            old = "".join(parts[2 * first : 2 * last + 1])
            if CHAINS[chain] >= EIGHT_BIT_COST and not _SUSPECT.search(old):
                continue  # letters of correctly read text
            decoded = parts[2 * first : 2 * last + 1]
            for j in own:  # of several decodings the shortest
                decoded[2 * (j - first)] = self._best(chain, options[j], parts, j) if fine else options[j][0]
            changed = []
            for j in own:  # a word that is shorter as it was stays, if that is worth naming it; good UTF-8 is no chance
                place = j - first
                if fine and len(own) > 1 and CHAINS[chain] >= EIGHT_BIT_COST and self._near(decoded, place, place, parts[2 * j]) + EXCEPTION_COST < self._near(decoded, place, place, decoded[2 * place]):
                    decoded[2 * place] = parts[2 * j]
                else:
                    changed.append(j)
            new, look = "".join(decoded), old.replace("ð", "đ").replace("Ð", "Đ")
            if changed and new != look:  # a letter that merely looks like đ is no wrong reading
                saved = min(self._near(parts, first, last, x) for x in {old, look}) - self._near(parts, first, last, new)
                if saved >= 0:
                    out.append(Stretch(first, last, changed, decoded, saved))
        return out

    def _best(self, chain: str, options: list[str], parts: list[str], j: int) -> str:
        """Of several decodings of word j along one chain the shortest, of those as good as equal the best known word.

        Letters of an 8-bit encoding are decoded rather than left where nothing else tells.
        """
        if len(options) == 1:
            return options[0]
        sizes = {x: self._near(parts, j, j, x) for x in options}
        close = [x for x in options if sizes[x] <= min(sizes.values()) + EXCEPTION_COST]
        return max(close, key=lambda x: (sum(lang.words[w] for lang in self.languages for w in re.findall(r"\w+", x.lower())), -sizes[x] if CHAINS[chain] < EIGHT_BIT_COST else 0))

    def restore(self, text: str) -> tuple[str, list[str], int]:
        """(text as far as restored, chains found, words changed); the text itself, [] and 0 where nothing was found.

        A chain's cost is paid once a text: the chain that saves most over all its stretches, its cost included, is
        undone first, then the next among the words that are left, as long as one saves more than it costs.
        """
        parts = re.split("([ \t\r\n]+)", text)  # words at even places
        used: set[int] = set()
        chains, changed, open_chains, gains = [], 0, list(CHAINS), {}
        while open_chains:
            gains = gains or self._gains(open_chains, parts, used)
            name = max(open_chains, key=lambda x: gains[x])
            if gains[name] <= 0:
                break
            open_chains.remove(name)
            found = self._stretches(name, parts, used, fine=True)
            if sum(x.saved for x in found) <= CHAINS[name]:
                continue
            chains.append(name)
            for x in found:
                parts[2 * x.first : 2 * x.last + 1] = x.decoded
                used.update(range(x.first, x.last + 1))
                changed += len(x.own)
            gains = {}
        return "".join(parts), sorted(chains), changed

    def _gains(self, chains: list[str], parts: list[str], used: set[int]) -> dict[str, float]:
        """What each chain would save over the unused words, its cost taken off.

        Letters of correct words can come from an 8-bit encoding too: where no chain saves anything as it stands, those
        chains are told by their fine stretches.
        """
        total = lambda x, fine: sum(s.saved for s in self._stretches(x, parts, used, fine)) - CHAINS[x]
        out = {x: total(x, False) for x in chains}
        if all(gain <= 0 for gain in out.values()):
            out |= {x: total(x, True) for x in chains if CHAINS[x] >= EIGHT_BIT_COST}
        return out


def _word_pairs(documents: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, first, second, n: neighbouring words of all labelled documents that hold nothing suspicious.

    A line end is a word; the last word of a text has null behind it.
    """
    scan = TextScan(SUSPECT, SUSPECT_PAIRS)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            suspicious = set(scan(texts))
            for name in LANGUAGES:
                clean = [unicodedata.normalize("NFC", x).encode("utf-8", "surrogatepass") for i, x in enumerate(texts) if labels[i] == name and i not in suspicious]
                lists = pc.split_pattern(pc.replace_substring(pa.array(clean, pa.binary()).view(pa.string()), "\n", " \n "), " ")
                words = lists.flatten().dictionary_encode()
                codes, ends = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()[1:]
                size = len(words.dictionary) + 1
                behind = np.append(codes[1:], size - 1)
                behind[ends[ends > 0] - 1] = size - 1
                pairs, n = np.unique(codes * size + behind, return_counts=True)
                held = pa.concat_arrays([words.dictionary, pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), pa.string()), held.take(pa.array(pairs // size)), held.take(pa.array(pairs % size)), pa.array(n, pa.int64())], names=["lang", "first", "second", "n"])

    labelled = documents.where(F.col(text).isNotNull()).select(F.lower(F.trim(F.col(lang))).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(*LANGUAGES))
    return labelled.mapInArrow(steps, "lang string, first string, second string, n bigint").groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))


def _letters_and_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of counted words the cells of their lower-case words, and after these a place for each letter."""
    for batch in batches:
        counts: dict[tuple[str, int], int] = Counter()
        for name, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for x in re.findall(r"\w+", word.lower()):
                counts[name, WordCounts.cell(x)] += n
            for c in set(word):
                counts[name, CELLS + ord(c)] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["lang", "cell", "n"])


def _walk(pairs: list[tuple[str, str | None, int]], seed: int = 0) -> list[str]:
    """Texts that hold each pair of neighbouring words n times, by a seed; what stands in them is alike from first to last."""
    rng = random.Random(seed)
    behind: dict[str, list[str | None]] = {}
    for first, second, n in sorted(pairs, key=lambda x: (x[0], x[1] or "", x[2])):
        behind.setdefault(first, []).extend([second] * n)
    for ways in behind.values():
        rng.shuffle(ways)
    starts = [word for word, ways in behind.items() for _ in ways]
    rng.shuffle(starts)
    out = []
    for word in starts:
        text = [word]
        while word is not None and (ways := behind.get(word)):
            word = ways.pop()
            if word is not None:
                text.append(word)
        if len(text) > 1:
            out.append(" ".join(text))
    return out


def train(documents: DataFrame, text: str, lang: str) -> list[Language]:
    """A dictionary for each language, from all of its documents that hold nothing suspicious.

    Pairs of neighbouring words, words and letters are counted over all of them. The dictionary is trained on a text of
    about MODEL_WORDS words in which pairs stand in proportion to their counts (all of them, if there are no more than
    that), so neither the order of rows nor their files matter.
    """
    pairs = cut(_word_pairs(documents, text, lang))
    total = pairs.groupBy("lang").agg(F.sum("n").alias("total"))
    times = F.round(F.col("n") * F.least(F.lit(1.0), F.lit(float(MODEL_WORDS)) / F.col("total"))).cast("long")
    often: dict[str, list] = {}
    for x in pairs.join(F.broadcast(total), "lang").select("lang", "first", "second", times.alias("n")).where("n > 0").toArrow().to_pylist():
        often.setdefault(x["lang"], []).append((x["first"], x["second"], x["n"]))
    words = pairs.groupBy("lang", F.col("first").alias("word")).agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(_letters_and_cells, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    labels, cells, n = np.array(counted.column("lang").to_pylist(), object), counted.column("cell").to_numpy(), counted.column("n").to_numpy()
    out = []
    for name in LANGUAGES:
        if name in often:
            own = labels == name
            table = np.zeros(CELLS, np.uint32)
            word = own & (cells < CELLS)
            table[cells[word]] = np.minimum(n[word], 2**32 - 1)
            # dictionaries are trained on pieces of the length that is compressed later
            samples = [x[i : i + 200].encode("utf-8", "surrogatepass") for x in [" ".join(_walk(often[name])).replace(" \n ", "\n")] for i in range(0, len(x), 200)]
            out.append(Language(samples, {chr(c - CELLS) for c in cells[own & (cells >= CELLS)]}, WordCounts(table)))
    return out


#: A lost character beside a letter: its byte was in no table, so the word was read in a wrong encoding.
LOST = re.compile(f"[^\\W\\d_]{chr(0xFFFD)}|{chr(0xFFFD)}[^\\W\\d_]")


def restore_encoding(documents: DataFrame, key: str, text: str, lang: str = "lang") -> DataFrame:
    """Documents in which some words were read in a wrong encoding: doc_id, chains, changed_words, restored.

    restored is the text with every stretch decoded that could be; the rest stays. A text whose lost characters stand
    beside letters is damaged whether or not anything can be decoded (chains may be empty). Null keys and texts are
    skipped, a row that comes twice gives two rows, and documents without a finding have none.
    """
    restorer = Restorer(train(documents, text, lang))
    scan = TextScan(SUSPECT, SUSPECT_PAIRS)
    key_type = documents.schema[key].dataType.simpleString()

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [(k, *found) for k in scan(texts) if (found := restorer.restore(texts[k]))[1] or LOST.search(texts[k])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())],
                names=["doc_id", "chains", "changed_words", "restored"],
            )

    suspects = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return suspects.mapInArrow(steps, f"doc_id {key_type}, chains array<string>, changed_words int, restored string")
