"""English names of books, for sources that bring no catalogue of their own."""

from __future__ import annotations

#: One line per book, by number from 1 on; the first name is the full one.
_ENGLISH = """
Genesis|Gen|Gn
Exodus|Exod|Exo
Leviticus|Lev|Lv
Numbers|Num|Nm
Deuteronomy|Deut|Deu|Dt
Joshua|Josh|Jos
Judges|Judg|Jdg
Ruth|Rth
1 Samuel|1 Sam|First Samuel|I Samuel
2 Samuel|2 Sam|Second Samuel|II Samuel
1 Kings|1 Kgs|1 Kin|First Kings|I Kings
2 Kings|2 Kgs|2 Kin|Second Kings|II Kings
1 Chronicles|1 Chr|1 Chron|First Chronicles|I Chronicles
2 Chronicles|2 Chr|2 Chron|Second Chronicles|II Chronicles
Ezra|Ezr
Nehemiah|Neh
Esther|Esth|Est
Job|Jb
Psalms|Psalm|Ps|Psa
Proverbs|Prov|Pr
Ecclesiastes|Eccl|Ecc|Qoheleth
Song of Solomon|Song of Songs|Song|Canticles
Isaiah|Isa
Jeremiah|Jer
Lamentations|Lam
Ezekiel|Ezek|Eze
Daniel|Dan
Hosea|Hos
Joel|Jl
Amos|Am
Obadiah|Obad|Ob
Jonah|Jon
Micah|Mic
Nahum|Nah
Habakkuk|Hab
Zephaniah|Zeph|Zep
Haggai|Hag
Zechariah|Zech|Zec
Malachi|Mal
Matthew|Matt|Mat|Mt
Mark|Mrk|Mk
Luke|Luk|Lk
John|Jhn|Jn
Acts|Act|Acts of the Apostles
Romans|Rom
1 Corinthians|1 Cor|First Corinthians|I Corinthians
2 Corinthians|2 Cor|Second Corinthians|II Corinthians
Galatians|Gal
Ephesians|Eph
Philippians|Phil|Php
Colossians|Col
1 Thessalonians|1 Thess|1 Thes|First Thessalonians|I Thessalonians
2 Thessalonians|2 Thess|2 Thes|Second Thessalonians|II Thessalonians
1 Timothy|1 Tim|First Timothy|I Timothy
2 Timothy|2 Tim|Second Timothy|II Timothy
Titus|Tit
Philemon|Phlm|Phm
Hebrews|Heb
James|Jas|Jam
1 Peter|1 Pet|First Peter|I Peter
2 Peter|2 Pet|Second Peter|II Peter
1 John|1 Jn|1 Jhn|First John|I John
2 John|2 Jn|2 Jhn|Second John|II John
3 John|3 Jn|3 Jhn|Third John|III John
Jude
Revelation|Rev|Apocalypse
1 Esdras|1 Esd|First Esdras
2 Esdras|2 Esd|Second Esdras
Tobit|Tob
Judith|Jdt
Additions to Esther|Add Esth
Additional Psalm|Psalm 151
Wisdom|Wis|Wisdom of Solomon
Sirach|Sir|Ecclesiasticus
Baruch|Bar
Prayer of Azariah|Pr Azar
Susanna|Sus
Bel and the Dragon|Bel
Prayer of Manasses|Prayer of Manasseh|Pr Man
1 Maccabees|1 Macc|First Maccabees
2 Maccabees|2 Macc|Second Maccabees
3 Maccabees|3 Macc|Third Maccabees
4 Maccabees|4 Macc|Fourth Maccabees
"""


def english(code: str) -> list[tuple[str, str, int]]:
    """(code, name, book number) of all names."""
    return [(code, name, i) for i, line in enumerate(_ENGLISH.split("\n")[1:-1], 1) for name in line.split("|")]
