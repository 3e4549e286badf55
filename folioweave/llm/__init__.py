"""Training-data operators: search, sharding, de-duplication, filtering, mixing and token output."""
