"""The scratch tables of the library, for the operators here."""

from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
