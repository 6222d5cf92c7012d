"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallywright.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from tallywright.llm.fingerprints import op8_fingerprints
from tallywright.llm.jaccard import OP5_SQL, op5_jaccard
from tallywright.llm.languages import op12_languages
from tallywright.llm.licenses import OP10_SQL, op10_licenses
from tallywright.llm.mixing import OP7_SQL, op7_mixing
from tallywright.llm.neighbours import op2_neighbours
from tallywright.llm.packing import op9_packing
from tallywright.llm.privacy import OP4_SQL, op4_privacy
from tallywright.llm.toxicity import op1_toxicity
from tallywright.llm.urls import OP3_SQL, op3_urls
from tallywright.llm.vector_codes import OP11_SQL, op11_vector_codes
from tallywright.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_neighbours": op2_neighbours,
    "op3_urls": op3_urls,
    "op4_privacy": op4_privacy,
    "op5_jaccard": op5_jaccard,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_vector_codes": op11_vector_codes,
    "op12_languages": op12_languages,
    "op13_conversation_trie": op13_conversation_trie,
}
SQL = {
    "op3_urls": OP3_SQL,
    "op4_privacy": OP4_SQL,
    "op5_jaccard": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op10_licenses": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
