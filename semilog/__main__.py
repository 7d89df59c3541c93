import sys

from semilog.cli import main

sys.exit(main())
