"""Operators that prepare training text: cleaning, joining near copies, mixing, packing and writing of token ids."""
