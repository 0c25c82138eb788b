"""Training-data operators: every module holds one operator, ``queries`` registers them."""
