"""Readers of source trees and captures, and the snapshot store."""
