"""Language identification in plain Python: what the operator must say."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict


def words_of(text):
    found, word = [], ""
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        elif word:
            found.append(word)
            word = ""
    return found + [word] if word else found


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def logs_of(counts, languages):
    """key -> log frequency by language; counts: language -> Counter."""
    total = {n: sum(counts[n].values()) for n in languages}
    out = {}
    for key in {k for n in languages for k in counts[n]}:
        mean = sum(counts[n][key] / max(1, total[n]) for n in languages) / len(languages)
        out[key] = [math.log(counts[n][key] + 100.0 * mean) - math.log(total[n] + 100.0) for n in languages]
    return out


def predictions(rows):
    """rows: (doc_id, text, lang). doc_id -> (lang, score), learned from what is not held out, equal texts of a language once."""
    learned = {(lang, text) for doc_id, text, lang in rows if not held_out(doc_id) and lang is not None and text is not None}
    words, grams = defaultdict(Counter), [defaultdict(Counter) for _ in range(4)]
    for lang, text in learned:
        words[lang].update(words_of(text))
    languages = sorted(n for n in words if words[n])
    for lang in languages:
        for word, n in words[lang].items():
            padded = f"<{word}>"
            for size in range(1, 5):
                for i in range(len(padded) - size + 1):
                    grams[size - 1][lang][padded[i : i + size]] += n
    of_words, of_grams = logs_of(words, languages), [logs_of(g, languages) for g in grams]

    def score(word):
        if word in of_words:
            return of_words[word]
        padded, sums = f"<{word}>", [0.0] * len(languages)
        for end in range(1, len(padded) + 1):
            for size in range(min(4, end), 0, -1):
                found = of_grams[size - 1].get(padded[end - size : end])
                if found:
                    sums = [a + b for a, b in zip(sums, found, strict=True)]
                    break
        return [s / 4 for s in sums]

    said = {}
    for doc_id, text, _ in rows:
        seen = words_of(text or "")
        if not seen or not languages:
            said[doc_id] = ("und", 0.0)
            continue
        total = [sum(c) for c in zip(*map(score, seen), strict=True)]
        best = max(range(len(languages)), key=lambda i: (total[i], -i))
        share = min(1.0, 20 / len(seen))
        said[doc_id] = (languages[best], 1 / sum(math.exp((t - total[best]) * share) for t in total))
    return said
