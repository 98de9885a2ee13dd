"""Pattern packs by language of the corpus: what a structure level, a modality, a reference or a magnitude looks like.

Operators take a pack as a parameter. ``generic`` fits prose in Latin script, ``ru`` Russian statutes. Patterns are matched on
lower-cased text, so they need no case folding of their own. The packs are fixed values: words and headers of the languages. Digit
classes are spelt out so that all engines agree on them.
"""

from __future__ import annotations

#: Header of each structure level, coarse to fine, for Python's ``re`` with line anchors.
LEVELS = {
    "generic": [("section", r"(?m)^#\s*(.+)$"), ("chapter", r"(?m)^(?=.{1,40}$)(.+)$"), ("article", r"(?m)^(?=.{41,80}$)(.+)$"), ("part", r"(?m)^(\d+)\.\s+")],
    "ru": [("section", r"(?mi)^раздел\s+([ivxlc\d]+)"), ("chapter", r"(?mi)^глава\s+([ivxlc\d]+)"), ("article", r"(?mi)^статья\s+(\d+(?:\.\d+)*)"), ("part", r"(?m)^(\d+)\.\s+"), ("point", r"(?m)^(\d+)\)\s+"), ("subpoint", r"(?mi)^([а-я])\)\s+")],
}

#: Modality classes in the order in which they are tried; what fits none is the first.
MODALITY = {
    "generic": [("mandatory", "must|shall"), ("prohibited", "may not|never"), ("permitted", "may|can"), ("conditional", "if|when")],
    "ru": [
        ("mandatory", "обязан|долж(ен|на|но|ны)|следует|необходимо|требуется|подлежит|в обязательном порядке|обязательно"), ("prohibited", "запреща|не допуска|не может|не вправе|не имеет права|недопустимо|исключается"),
        ("permitted", "вправе|может|имеет право|допуска|разреша|позволяется"), ("conditional", "если|в случае|при условии|при наличии|при соблюдении|при выполнении"),
    ],
}

#: References to articles and laws, with the number as group 1.
REFERENCES = {
    "generic": {"article": r"([0-9]+)\.[0-9]+", "law": r"version ([0-9]+)"},
    "ru": {"article": r"стать[а-я]*\s+([0-9]+(?:\.[0-9]+)*)", "law": r"([0-9]+)-фз"},
}

#: Factors of magnitude words.
MAGNITUDES = {"generic": {"thousand": 1e3, "million": 1e6, "billion": 1e9}, "ru": {"тыс": 1e3, "млн": 1e6, "млрд": 1e9}}
