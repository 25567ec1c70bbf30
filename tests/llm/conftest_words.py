import re

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
