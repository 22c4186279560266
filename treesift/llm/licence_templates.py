"""Notices of common licences, as their texts ask to be written, by family."""

TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("apache", "apache-2.0 line", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache-2.0 notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "apache-2.0 disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "mit line", "Released under the MIT License."),
    ("mit", "mit grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("mit", "mit condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl", "gpl-3.0 line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gpl notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "gpl disclaimer", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "lgpl line", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "lgpl notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("agpl", "agpl line", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "bsd line", "Released under the BSD 3-Clause License."),
    ("bsd", "bsd grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "bsd endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl", "mpl notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "isc grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "cc-by line", "Licensed under CC BY 4.0."),
    ("cc-by", "cc-by notice", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "cc-by-sa line", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "cc-by-sa notice", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "cc-by-nc line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "cc-by-nc notice", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "cc0 notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "unlicense notice", "This is free and unencumbered software released into the public domain."),
)

# Own sentences in licence words that grant nothing: they teach the unknown class.
NO_LICENCE: tuple[str, ...] = (
    "The driver must carry a valid license at all times.",
    "Version 2.0 of the software was released in May.",
    "The general public is welcome to visit the new library.",
    "This work is part of a longer series under the same name.",
    "Copyright law was the subject of the second lecture.",
    "He was granted permission to use the source of the river.",
    "A fishing license is required for any person above sixteen.",
    "The conditions of the contract were met without restriction.",
    "All rights to the house were sold with the furniture.",
    "The creative team published a common statement.",
    "The software comes with a manual and a warranty of two years.",
    "Students at MIT released a study about the public domain.",
    "The Apache helicopter was redistributed to another base.",
    "The license of the pub was revoked by the city.",
)
