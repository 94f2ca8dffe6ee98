"""Inputs: types by first bytes, known forms, dictionaries, and their audit."""
