"""Table layouts and the fixed values of the index."""

from __future__ import annotations

#: Hit types in order, their weights, and the largest position each keeps.
HIT_TYPES = ("content", "quote1", "quote2", "quote3", "signature", "subject", "from", "wrote")
HIT_WEIGHTS = (1000.0, 150.0, 25.0, 4.0, 0.5, 1.0, 0.1, 0.05)
HIT_MASKS = (127, 31, 31, 31, 7, 7, 7, 7)
#: Hits of a word that a message keeps, messages a word needs, widest child bucket.
HITS_MOST, MESSAGES_LEAST, BUCKET_MOST = 255, 2, 31
#: Hits of a search result, and distance of words that have no comparable places.
RESULT_HITS, FAR = 4, 127
#: Weight of a word reached by 1, 2, 3 edits.
FUZZY_WEIGHTS = (0.01, 0.001, 0.0001)

MESSAGES = "idx long, msgid string, refs array<string>, epoch long, author string, subject string, newsgroups string, body string"
CONN = "idx long, epoch long, parent long, child_total long, children array<long>"
POSTINGS = "word string, idx long, child_bucket int, hitnum int, hits array<struct<type:int,pos:int>>"
SCORE_RULES = "score int, field string, exact boolean, ignore_case boolean, match string"
ARCHIVES = "archive_id int, name string, desc_short string, desc_long string, available boolean"
