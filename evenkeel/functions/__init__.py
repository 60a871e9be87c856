from evenkeel.functions.hashing import hash_key, hash_pick, hash_uniform
from evenkeel.functions.numeric import (
    euclidean,
    half_even,
    half_even_to,
    lerp,
    nan_to_null,
    safe_divide,
    squared_distance,
    try_double,
)

__all__ = [
    "euclidean", "half_even", "half_even_to", "hash_key", "hash_pick", "hash_uniform",
    "lerp", "nan_to_null", "safe_divide", "squared_distance", "try_double",
]
