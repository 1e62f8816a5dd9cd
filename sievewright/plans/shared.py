"""Folders that a cluster's machines share."""

from sievewright.storage import shared_folder

__all__ = ["shared_folder"]
