from drillbook.functions.columns import (
    day_word,
    hash_number,
    hash_numbers,
    letter,
    local_date,
    names_failed,
    stable_id,
)

__all__ = ["day_word", "hash_number", "hash_numbers", "letter", "local_date", "names_failed", "stable_id"]
