"""Texts for the piece models, and the words of a text."""

import random
import re
import zlib

rng = random.Random(3)
WORDS = ["the", "Hello", "world", "naïve", "Straße", "entzündlich", "$$$", "&&&", "12345", "don't", "señor", "日本", "über", "x;", "foo.bar", "###"]
TEXTS = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", ",", "ing"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
TEXTS += ["", " ", "  a  b\n\n c\t日本語 𝄞 𝄞é\x00z", "a" * 100 + " " + "日" * 60, "x" * 4000, "\n", "\r\n x;\r", "ab" * 50 + "the" * 40, "▁ ▁x"]
TEXTS += [" " * i + "He llo" + " " * (40 - i) for i in range(40)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def equal_checksums():
    """Two words of one length and one crc32; texts that differ in nothing else have one crc32 as well."""
    rng, met = random.Random(32), {}
    while True:
        word = "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
        other = met.setdefault(zlib.crc32(word.encode()), word)
        if other != word:
            return other, word
