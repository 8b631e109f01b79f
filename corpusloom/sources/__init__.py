"""Reading file trees and writing pages and logs."""
