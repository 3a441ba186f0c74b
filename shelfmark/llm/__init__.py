"""Preparation of book texts as training data: quality, personal data, licences, copies, mixing, packing."""
