"""Which errors say something about one file, and which would meet every file."""


class ServiceUnavailable(Exception):
    """For extractors and readers to raise when what they depend on does not answer, whatever the file."""


#: Operating system errors that are about the file at hand. All others - connections, timeouts, disks - are outages.
OF_ONE_FILE = (FileNotFoundError, PermissionError, IsADirectoryError, NotADirectoryError)


def is_outage(problem: BaseException) -> bool:
    """True for errors that are not about the file: a service, a disk or memory that fails. They must end the run, not mark a claim."""
    if isinstance(problem, (ServiceUnavailable, MemoryError)):
        return True
    return isinstance(problem, OSError) and not isinstance(problem, OF_ONE_FILE)


def error_text(problem: BaseException) -> str:
    """Class and message of an error that is about a file."""
    return f"{type(problem).__name__}: {problem}"[:2_000]
