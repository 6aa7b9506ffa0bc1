"""Well-formed classical Tibetan syllables, as one regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Affixes, suffixes, and the syllable stems by what may follow them.
AFFIXES = """
འི འོ འིའོ ར ས འང འམ འིའང འིའམ འོའང འོའམ
""".split()
SUFFIXES = """
ག གས ང ངས ད ན བ བས མ མས ལ
""".split()
VOWELS = "\u0f72\u0f74\u0f7a\u0f7c"
# take a vowel and a suffix
OPEN = """
ཧྥ ཀ ཀྱ ཀྲ ཀླ དཀྱ དཀྲ བཀྱ བཀྲ བཀླ རྐ རྐྱ ལྐ སྐ སྐྱ སྐྲ བརྐ བརྐྱ བསྐ བསྐྱ བསྐྲ ཁ ཁྱ ཁྲ མཁྱ མཁྲ འཁྱ
འཁྲ ག གྱ གྲ གླ དགྱ དགྲ བགྱ བགྲ མགྱ མགྲ འགྱ འགྲ རྒ རྒྱ ལྒ སྒ སྒྱ སྒྲ བརྒ བརྒྱ བསྒ བསྒྱ བསྒྲ ང རྔ ལྔ
སྔ བརྔ བསྔ ཅ ལྕ ཆ ཇ རྗ ལྗ བརྗ ཉ རྙ སྙ བརྙ བསྙ ཏ རྟ ལྟ སྟ བརྟ བལྟ བསྟ ཐ ད དྲ འདྲ རྡ ལྡ སྡ བརྡ བལྡ བསྡ
ན རྣ སྣ བརྣ བསྣ པ པྱ པྲ དཔྱ དཔྲ ལྤ སྤ སྤྱ སྤྲ ཕ ཕྱ ཕྲ འཕྱ འཕྲ བ བྱ བྲ བླ དབྱ དབྲ འབྱ འབྲ རྦ ལྦ སྦ
སྦྱ སྦྲ མ མྱ དམྱ རྨ རྨྱ སྨ སྨྱ ཙ རྩ སྩ བརྩ བསྩ ཚ ཛ རྫ བརྫ ཝ ཞ ཟ ཟླ བཟླ འ ཡ ར རླ བརླ ལ ཤ ས སྲ སླ བསྲ
བསླ ཧ ཧྲ ལྷ ཨ
""".split()
# take an affix, which they need
AFFIXED = """
བགླ ཏྲ མྲ སྨྲ སྨྲེ རྒྭ ཀརྨ པདྨ ཨཱ རྒྭ བསྭེ རྭི དྭ ཀྲའུ ཀྲུའུ ཁྲུའུ སྒྱིའུ ཅོའུ གཅོའུ ཐུའུ དུའུ དྲིའུ
ཕེའུ མུའུ མོའུ ཚུའུ ལོའུ ཧུའུ ཧེའུ ཧྲུའུ བྲའོ སླེའོ ཀའུ ཀིའུ ཀེའུ ཁིའུ ཁེའུ ཁྱིའུ ཁྱེའུ ཁྲིའུ ཁྲེའུ
གའུ གྲིའུ གྲེའུ གླེའུ འགིའུ རྒེའུ སྒའུ སྒེའུ སྒྱེའུ སྒྲེའུ རྔེའུ སྔེའུ ཅེའུ གཅིའུ གཅེའུ ལྕེའུ རྗེའུ
ཉེའུ སྙེའུ ཏེའུ གཏེའུ རྟའུ རྟེའུ སྟེའུ ཐའུ ཐིའུ ཐེའུ ཐོའུ མཐེའུ དེའུ དྲེའུ མདེའུ རྡེའུ ལྡེའུ སྡེའུ
ནའུ ནེའུ སྣེའུ དཔེའུ སྤའུ སྤེའུ སྤྱིའུ སྤྲེའུ ཕྲའུ ཕྲེའུ འཕེའུ བེའུ བྱའུ བྱིའུ བྱེའུ བྲའུ བྲེའུ
བྲོའུ འབེའུ སྦྲེའུ མིའུ མྱིའུ རྨེའུ སྨེའུ ཙིའུ ཙེའུ གཙེའུ རྩིའུ རྩེའུ ཚའུ ཚེའུ མཚེའུ མཚེའུ རྫིའུ
རྫེའུ གཞུའུ ཟེའུ ཡེའུ གཡིའུ རེའུ ལའུ ལིའུ ལེའུ ཤའུ ཤེའུ སིའུ སེའུ སྲིའུ སླེའུ བསེའུ ཨའུ ཀྭ ཀྭའི ཁྭ
གྭ གྲྭ ཉྭ དྭོ དྲྭ ཕྱྭ རྩྭ ཚྭ ཞྭ ཟྭ རྭ ལྭ ཤྭ སྭོ བསྭ བསྭོ ཧྭ
""".split()
# take a-chung, or a vowel and a suffix; one of them is needed
BARE = """
དཀ བཀ མཁ འཁ དག བག མག འག དང མང གཅ བཅ མཆ འཆ མཇ འཇ གཉ མཉ གཏ བཏ མཐ འཐ གད བད མད འད གན མན དཔ འཕ དབ འབ དམ
གཙ བཙ མཚ འཚ མཛ འཛ གཞ བཞ གཟ བཟ གཡ གཤ བཤ གས བས
""".split()
# take nothing
WHOLE = """
དམེའ མེའ མདྲོན བརྡའ བརྟའ ཏྲེས ཐྲིག སྨྲོས སྨྲས སྨྲེང སྨྲངས སྨྲང སྣྲོན སྣྲུབས སྣྲེལ རྭང དྭང ཏྭོན ཀྭན
ཀྭས ཧྭང དབའས ནོའུར དྭངས དྭགས ཚྭབ ཧྭག ཧྭགས
""".split()


def _any(*lists: list[str]) -> str:
    return "(?:" + "|".join(x for y in lists for x in y) + ")"


_ENDING = _any(SUFFIXES, AFFIXES)
SYLLABLE = "|".join(
    (
        _any(WHOLE),
        f"{_any(BARE)}(?:འ|[{VOWELS}]{_ENDING}?|{_ENDING})",
        f"{_any(AFFIXED)}{_any(AFFIXES)}",
        f"{_any(OPEN)}[{VOWELS}]?{_ENDING}?",
    )
)
LETTER = "[\u0f40-\u0f6c]"


def valid_weight(token: Column, invalid: int = 70, nontibetan: int | None = None) -> Column:
    """100 if the token, without blanks and tshegs, is a well-formed syllable; nontibetan if it has no Tibetan letter."""
    bare = F.regexp_replace(token, r"(?U)[\s\u0f0b\u0fd2]", "")
    return F.when(~token.rlike(LETTER), F.lit(nontibetan).cast("int")).when(bare.rlike(f"^(?:{SYLLABLE})$"), F.lit(100)).otherwise(F.lit(invalid))
