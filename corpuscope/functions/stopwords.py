"""Stop words."""

# The Snowball English list, in its own order.
SNOWBALL = """
a about above after again against all am an and any are aren't as at be because
been before being below between both but by can cannot could couldn't did didn't
do does doesn't doing don't down during each few for from further had hadn't has
hasn't have haven't having he he'd he'll he's her here here's hers herself him
himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself
let's me more most mustn't my myself no nor not of off on once only or other
ought our ours ourselves out over own same shan't she she'd she'll she's should
shouldn't so some such than that that's the their theirs them themselves then
there there's these they they'd they'll they're they've this those through to too
under until up very was wasn't we we'd we'll we're we've were weren't what what's
when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

# Words that biomedical prose adds.
DOMAIN = """
also among although may might must will however therefore thus furthermore
whether within without upon et al
""".split()

STOP_WORDS = SNOWBALL + DOMAIN


def reference_list(path: str) -> list[str]:
    """A list to compare with (one word a line), such as a published one that is too long to keep here."""
    with open(path, encoding="utf-8") as f:
        return list(dict.fromkeys(line.strip().lower() for line in f if line.strip()))


def compare(other: list[str], own: list[str] = STOP_WORDS) -> dict[str, list[str]]:
    """Words of both lists, of ours alone and of the other alone, sorted."""
    a, b = set(own), set(other)
    return {"both": sorted(a & b), "own_only": sorted(a - b), "other_only": sorted(b - a)}
